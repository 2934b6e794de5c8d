"""Language identification of mixed texts: scripts narrow the candidates, Viterbi with a switching penalty labels the words.

Learning counts hashed byte trigrams of words, and words by script, for each language over all rows
given; the counts are tables of fixed size that Spark adds up. In a text each run of letters is a word with
a score for each language that uses its script; the best path through the words pays a penalty for each
change of language, and runs of one language are spans. A text's language is the one with most letters.

Defined cases: null texts and texts without a letter are 'und' with score 0; ties go to the language first
in alphabetical order; words in a script that no language uses have no say; without any learnt
language all is 'und'; equal texts get equal results, and repeated rows count as often in learning; a very
long text is labelled whole; an empty table gives an empty result; extra columns are ignored. Languages
are counted in blocks of BLOCK_LANGUAGES, a pass over the texts of each, so that what a task counts has a
bound; all are candidates of every text. Beyond MOST_LANGUAGES, 256 KB of scores each, a task can't hold the
model: that raises a ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.llm.common import LOWER, plain_keys, slices, small_batches, text_buffer
from derivia.llm.slabs import gathered, slab_rows

GRAMS = 1 << 16
BLOCK_LANGUAGES = 128
MOST_LANGUAGES = 2048
#: Scores of trigrams that are looked up at once.
SCORES = 16 << 20
PENALTY = 8.0
#: The least score of a word for one language against another.
FLOOR = -12.0
#: Share of a language's words that makes a script one of its own.
OWN_SCRIPT = 0.01

# First code points of the ranges of Unicode scripts, and the script from there on.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
RANGE_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
RANGE_SCRIPT = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = True
LETTER[ord("a") : ord("z") + 1] = True
LETTER[128:] = True


class Runs:
    """The runs of letters of a text column: start, end, row, script, and the trigram bucket of each of their bytes."""

    def __init__(self, column: pa.Array):
        data, rows = text_buffer(column)
        n = len(data)
        inside = LETTER[data] if n else np.zeros(0, bool)
        cut = np.zeros(n + 1, bool)
        cut[rows] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.row = np.searchsorted(rows, self.starts, "right") - 1
        low = LOWER[data].astype(np.uint32)
        at = np.flatnonzero(inside)
        lengths = self.ends - self.starts
        self.begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[self.starts], last[self.ends - 1] = True, True
        left = np.where(first[at], 0, low[np.maximum(at - 1, 0)])
        right = np.where(last[at], 0, low[np.minimum(at + 1, max(n - 1, 0))]) if n else low
        key = (left * np.uint32(0x9E3779B1)) ^ (low[at] * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
        key ^= key >> np.uint32(15)
        self.gram = ((key * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)
        self.lengths = lengths
        s = self.starts
        b = [data[np.minimum(s + k, max(n - 1, 0))].astype(np.int64) if n else s for k in range(3)]
        point = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, 0xFFFF)))
        self.script = RANGE_SCRIPT[np.searchsorted(RANGE_STARTS, point, "right") - 1]
        self.data, self.rows = data, rows


def has_letter(column: pa.Array, runs: Runs) -> np.ndarray:
    """Whether each text has a letter; bytes beyond ASCII are looked at one text at a time where no ASCII letter settles it."""
    n = len(column)
    plain = np.zeros(n, bool)
    plain[runs.row[runs.data[runs.starts] < 128]] = True
    some = np.zeros(n, bool)
    some[runs.row] = True
    for k in np.flatnonzero(some & ~plain):
        plain[k] = any(c.isalpha() for c in column[int(k)].as_py())
    return plain


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log scores (GRAMS, languages), allowed (scripts, languages)) from all rows with a language."""
    small_batches(docs.sparkSession)
    docs = plain_keys(docs, text, lang).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null")
    names = sorted(r["lang"] for r in docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table, allowed = np.zeros((GRAMS, len(names)), np.float32), np.zeros((len(SCRIPTS), len(names)), bool)
    for start in range(0, len(names), BLOCK_LANGUAGES):
        block = names[start : start + BLOCK_LANGUAGES]
        mine = docs if len(block) == len(names) else docs.where(F.col("lang").isin(block))
        grams, scripts = counts(mine, block)
        table[:, start : start + len(block)] = (np.log(grams + 0.2) - np.log(grams.sum(axis=1, keepdims=True) + 0.2 * GRAMS)).T
        allowed[:, start : start + len(block)] = (scripts >= OWN_SCRIPT * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
    return names, table, allowed


def counts(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets (languages, GRAMS) and words by script (languages, scripts) of docs(text, lang), whose languages are all among names."""
    size = len(names) * GRAMS

    def count(batches):
        grams, scripts = np.zeros(size, np.int64), np.zeros(len(names) * len(SCRIPTS), np.int64)
        place = {x: i for i, x in enumerate(names)}
        for batch in slices(batches):
            runs = Runs(batch.column("text"))
            own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)[runs.row]
            grams += np.bincount(np.repeat(own * GRAMS, runs.lengths) + runs.gram, minlength=size)
            scripts += np.bincount(own * len(SCRIPTS) + runs.script, minlength=len(scripts))
        yield slab_rows(np.concatenate([grams, scripts]))

    cells = gathered(docs.mapInArrow(count, "slab int, cells binary"), size + len(names) * len(SCRIPTS), np.int64)
    return cells[:size].reshape(len(names), GRAMS), cells[size:].reshape(len(names), len(SCRIPTS))


def word_scores(table: np.ndarray, runs: Runs, most: int) -> np.ndarray:
    """The sum of its trigrams' scores for each word, from the table of at most `most` trigrams at a time, in parts of a longer word too."""
    out = np.zeros((len(runs.row), table.shape[1]), np.float32)
    begin, ends = runs.begin, runs.begin + runs.lengths
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(ends, begin[a] + most, "right")))
        if ends[a] - begin[a] > most:
            out[a] = sum(table[runs.gram[at : min(at + most, ends[a])]].sum(axis=0, dtype=np.float64) for at in range(begin[a], ends[a], most))
        else:
            out[a:b] = np.add.reduceat(table[runs.gram[begin[a] : ends[b - 1]]], begin[a:b] - begin[a], axis=0)
        a = b
    return out


def viterbi(score: np.ndarray, row_begin: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best state of each word under a penalty for each change; a text's words start at row_begin.

    All texts of the slice take each step together, longest first, so that those still running are a prefix.
    """
    path = np.zeros(len(score), np.int16)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return path
    begin, left = row_begin[order], counts[order]
    switched = np.zeros(score.shape, bool)
    source = np.zeros(len(score), np.int16)
    best = score[begin].astype(np.float64)
    running = np.searchsorted(-left, -np.arange(1, left[0] + 1), "right")  # texts with at least t words
    finals = np.zeros(len(order), np.int16)
    for t in range(1, left[0]):
        m = running[t]
        if m < len(best):
            finals[m : len(best)] = best[m:].argmax(axis=1)
            best = best[:m]
        at = begin[:m] + t
        top = best.argmax(axis=1)
        change = best[np.arange(m), top][:, None] - penalty
        moved = change > best
        switched[at], source[at] = moved, top
        best = np.maximum(best, change) + score[at]
    finals[: len(best)] = best.argmax(axis=1)
    state = finals
    for t in range(left[0] - 1, -1, -1):
        m = running[t]
        at = begin[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = np.where(switched[at, state[:m]], source[at], state[:m])
    return path


def labelled(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), spans: bool = False, penalty: float = PENALTY) -> DataFrame:
    """The columns `keep`, lang_pred, score, n_spans for each row of docs; with spans, also the spans as (start, end, lang) in UTF-8 bytes."""
    names, table, allowed = model
    shared = docs.sparkSession.sparkContext.broadcast((table, allowed))  # of a size that MOST_LANGUAGES bounds
    docs = plain_keys(docs, *keep, "text").withColumn("text", F.col("text").cast("string"))
    kinds = dict(docs.dtypes)

    def predict(batches):
        table, allowed = shared.value
        for batch in slices(batches, limit=SCORES // max(4, len(names))):  # scores of a slice stay near 64 MB
            column, n = batch.column("text"), batch.num_rows
            runs = Runs(column)
            letters = has_letter(column, runs)
            names_, values, counts_, found = ["und"] * n, np.zeros(n), np.zeros(n, np.int32), [[] for _ in range(n)]
            if names and len(runs.row):
                score = word_scores(table, runs, SCORES // len(names))
                open_ = allowed[runs.script]
                score[~open_ & open_.any(axis=1)[:, None]] = -1e9
                score[~open_.any(axis=1)] = 0
                score = np.maximum(score - score.max(axis=1, keepdims=True), FLOOR)
                counts = np.bincount(runs.row, minlength=n)
                begin = np.searchsorted(runs.row, np.arange(n))
                path = viterbi(score, begin, counts, penalty)
                mass = np.bincount(runs.row * len(names) + path, runs.lengths, n * len(names)).reshape(n, -1)
                top, total = mass.argmax(axis=1), np.maximum(mass.sum(axis=1), 1)
                values = np.where(letters, mass[np.arange(n), top] / total, 0.0)
                names_ = [names[k] if ok else "und" for k, ok in zip(top, letters, strict=True)]
                edge = np.ones(len(path), bool)
                edge[1:] = (path[1:] != path[:-1]) | (runs.row[1:] != runs.row[:-1])
                counts_ = np.where(letters, np.bincount(runs.row[edge], minlength=n), 0).astype(np.int32)
                if spans:
                    at = np.flatnonzero(edge)
                    ends = runs.ends[np.concatenate([at[1:], [len(path)]]) - 1]
                    for a, b in zip(at, ends, strict=True):
                        r = runs.row[a]
                        if letters[r]:
                            found[r].append({"start": int(runs.starts[a] - runs.rows[r]), "end": int(b - runs.rows[r]), "lang": names[path[a]]})
            out = [*(batch.column(c) for c in keep), pa.array(names_, pa.string()), pa.array(values, pa.float64()), pa.array(counts_, pa.int32())]
            more = [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] if spans else []
            yield pa.RecordBatch.from_arrays([*out, *more], [*keep, "lang_pred", "score", "n_spans", *["spans"] * spans])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double, n_spans int" + ", spans array<struct<start: int, end: int, lang: string>>" * spans
    return docs.mapInArrow(predict, schema)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for each row of docs(doc_id, text, lang), learnt from the rows that aren't held out (a null id isn't)."""
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    docs = plain_keys(docs, "doc_id", "text", "lang").withColumn("held_out", held)
    return labelled(docs.drop("lang"), learn(docs.where("not held_out")), ("doc_id", "held_out"))
