"""A quality classifier without hand labels: noisy heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a text. Spark counts the vote patterns of all documents (at
most 3 ** labellers of them), and expectation-maximisation over these counts estimates how often each
labeller gives each vote on good and on bad texts, and so the posterior of every pattern. A linear
model on hashed word and shape features is fitted to the posteriors of a bounded sample of rows, taken
from better and worse patterns alike and corrected for their real shares, and scores all documents.

Defined cases: null, empty and white-space-only texts have score 0 and are rejected; equal texts get
equal scores; a score at the threshold is kept; of the rows of an id the sample takes one; a very long
text is measured whole; an empty table gives an empty result; where no pattern looks bad, or none good,
the posterior itself is the score; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from derivia.llm.common import LOWER, U64, Words, mix, plain_keys, slices, small_batches, unused, written
from derivia.llm.linear import BITS, features, fit_on, probabilities

LABELLERS = ("signs", "edges", "echo", "windows", "capitals", "bare", "short", "stops")
#: Rows of each side that the scorer is fitted on.
SIDE_ROWS = 4000

IS_UPPER = np.zeros(256, bool)
IS_UPPER[ord("A") : ord("Z") + 1] = True
IS_LOWER = np.zeros(256, bool)
IS_LOWER[ord("a") : ord("z") + 1] = True
IS_LETTER = IS_UPPER | IS_LOWER | (np.arange(256) >= 128)
IS_SIGN = np.zeros(256, bool)
IS_SIGN[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()?-"]] = True


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """What the labellers look at, for each row."""
    words = Words(column)
    n = len(words.rows) - 1
    count = words.per_row if n else np.zeros(0)
    full = np.maximum(count, 1)
    row, data = words.row, words.data
    per = lambda x: np.bincount(row, x, n) / full
    out = {"words": count}
    last, first = (data[words.ends - 1], data[words.starts]) if len(row) else (data[:0], data[:0])
    total = np.concatenate([[0], np.cumsum(IS_SIGN[data])])
    upper = np.concatenate([[0], np.cumsum(IS_UPPER[data])])
    lower = np.concatenate([[0], np.cumsum(IS_LOWER[data])])
    signs = total[words.ends] - total[words.starts]
    out["signs"] = per(signs > 0)
    out["edges"] = per(IS_SIGN[last] & (signs >= 2))
    out["capitals"] = per((upper[words.ends] - upper[words.starts] >= 2) & (lower[words.ends] == lower[words.starts]))
    out["stops"] = per(np.isin(last, np.frombuffer(b".?!,", np.uint8)) & (first != last))
    words.data = LOWER[data]
    h = words.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out["echo"] = per(same)
    # words in windows of 8 that the text has more than once
    size = 8
    spread = np.zeros(n)
    if len(h) >= size:
        with np.errstate(over="ignore"):
            w = np.zeros(len(h) - size + 1, U64)
            for k in range(size):
                w = w * U64(0x9E3779B97F4A7C15) + h[k : k + len(w)]
            whole = row[: len(w)] == row[size - 1 :]
            w, r = mix(w + mix(row[: len(w)].astype(U64)))[whole], row[: len(w)][whole]
        _, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
        spread = np.bincount(r, times[inverse] > 1, n) / np.maximum(np.bincount(r, minlength=n), 1)
    out["windows"] = spread
    plain = np.concatenate([[0], np.cumsum(IS_LETTER[data])])
    letters = plain[words.ends] - plain[words.starts]
    out["bare"] = per(letters == 0)
    out["short"] = np.bincount(row, (letters > 0) & (letters <= 3), n) / np.maximum(np.bincount(row, letters > 0, n), 1)
    return out


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, labellers): 2 good, 1 bad, 0 nothing."""
    choose = lambda bad, good: np.where(bad, 1, np.where(good, 2, 0))
    some = m["words"] >= 8
    v = [
        choose(m["signs"] > 0.25, m["signs"] < 0.06),
        choose(m["edges"] > 0.15, m["edges"] < 0.04),
        choose(m["echo"] > 0.15, m["echo"] < 0.04),
        choose(some & (m["windows"] > 0.6), some & (m["windows"] < 0.1)),
        choose(some & (m["capitals"] > 0.3), m["capitals"] < 0.1),
        choose(m["bare"] > 0.2, m["bare"] < 0.04),
        choose((m["words"] >= 30) & (m["short"] < 0.06), some & (m["short"] > 0.15)),
        choose((m["words"] >= 30) & (m["stops"] < 0.01), some & (m["stops"] > 0.03)),
    ]
    return np.where(m["words"][:, None] == 0, 0, np.stack(v, axis=1))


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def posteriors(counts: dict[int, int], k: int = len(LABELLERS), rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Probability of good for each vote pattern, by EM on pattern counts, and the rates (good/bad, labeller, vote).

    Starts from the share of good votes, which fixes what the two classes mean; rates are those among the
    votes given (to give none says nothing) and smoothed by one pseudo-row for each.
    """
    pats = np.array(sorted(counts))
    weight = np.array([counts[p] for p in pats], float)
    v = pats[:, None] // 3 ** np.arange(k) % 3
    good = (v == 2).sum(1) + 1.0
    p = good / (good + 3.0 * (v == 1).sum(1) + 1.0)
    for _ in range(rounds):
        rates = np.full((2, k, 3), 1e-9)
        for c, share in enumerate((p, 1 - p)):
            for x in (1, 2):
                rates[c, :, x] = ((v == x) * (weight * share)[:, None]).sum(0) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        prior = min(max((weight * p).sum() / weight.sum(), 1e-3), 1 - 1e-3)
        ratio = np.log(rates[0, np.arange(k), v]) - np.log(rates[1, np.arange(k), v])
        z = np.log(prior / (1 - prior)) + np.where(v > 0, ratio, 0.0).sum(1)
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(pats.tolist(), p.tolist(), strict=True)), rates


def scorer(docs: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """The function texts -> scores (0 to 1) that docs(doc_id, text) teach; it travels to the tasks with its model."""
    small_batches(docs.sparkSession)
    docs = plain_keys(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))

    def vote(batches):
        for batch in slices(batches):
            m = measures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pattern(votes(m)).astype(np.int32)), pa.array(m["words"] > 0)], ["doc_id", "pattern", "has_words"])

    voted = written(docs.select("doc_id", "text").mapInArrow(vote, f"doc_id {dict(docs.dtypes)['doc_id']}, pattern int, has_words boolean"), "votes")
    counts = {r["pattern"]: r["count"] for r in voted.where("has_words").groupBy("pattern").count().collect()}  # at most 3 ** labellers
    table, _ = posteriors(counts) if counts else ({}, None)
    known = docs.sparkSession.createDataFrame(sorted(table.items()), "pattern int, good double")  # as many rows
    rated = voted.where("has_words and doc_id is not null").join(F.broadcast(known), "pattern")

    # a bounded sample from both sides, by the hash of the id; of an id's rows one counts
    model = None
    if any(x > 0.5 for x in table.values()) and any(x <= 0.5 for x in table.values()):
        rated = rated.groupBy("doc_id").agg(F.min("good").alias("good")).withColumn("h", F.xxhash64("doc_id"))
        side = lambda condition: rated.where(condition).orderBy("h", "doc_id").limit(SIDE_ROWS)
        ids = written(side("good > 0.5").union(side("good <= 0.5")).select("doc_id", "good"), "sample")
        # the sample's ids are bounded by SIDE_ROWS, so this join needs no shuffle of the texts
        sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
        model = fit_on(sample.select("text", F.array("good", 1 - F.col("good")).alias("target")), 2)
        there = ids.agg(F.avg("good")).first()[0]
    if model is not None:
        # the sample has both sides in other shares than the corpus
        share = sum(table[p] * n for p, n in counts.items()) / sum(counts.values())
        model = model[0], model[1] + np.log([share / there, (1 - share) / (1 - there)])

    def score(column: pa.Array) -> np.ndarray:
        if model is None:
            m = measures(column)
            p, words = np.array([table.get(int(x), 0.0) for x in pattern(votes(m))], float), m["words"]
        else:
            row, bucket, value = features(column, BITS)
            p, words = probabilities(row, bucket, value, len(column), *model)[:, 0], np.bincount(row, minlength=len(column))
        return np.where(words > 0, p, 0.0).astype(float)

    return score


def scored(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1) and kept for each row of docs(doc_id, text)."""
    score = scorer(docs)

    def run(batches):
        for batch in slices(batches):
            p = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "kept"])

    docs = plain_keys(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, kept boolean")


def accepted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that the classifier keeps, with their columns."""
    score, name = scorer(docs), unused(docs, "_kept")

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.column("text")) >= threshold)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BooleanType())])).where(F.col(name)).drop(name)
