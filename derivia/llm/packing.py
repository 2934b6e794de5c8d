"""Best-fit packing of token sequences under vector capacities.

A bin has residual capacities (tokens, documents, attention cost = sum of squared lengths). Which bins
exist depends only on how many pieces there are of each length, and there are at most max_tokens
lengths. So the corpus is tokenised once, its lengths are counted in Spark, vector best-fit runs on that
bounded histogram (open bins with the same residual are one class), and the pieces are then dealt to
the slots of the bins by their rank within their length. No piece passes through the driver and no
task holds a group: ranks come from salted runs of about RUN_ROWS pieces, as many as a length needs.

Defined cases: a null text is an empty one (it holds the end token alone); a null doc_id stays null;
repeated rows are pieces of their own; a very long text is encoded whole and cut; ties of bins go to the
one opened first; an empty table gives an empty result; extra columns of documents are ignored, those of
pieces stay; a piece that breaks a capacity on its own can't be packed and raises ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from derivia.llm.common import plain_keys, slices, small_batches, written

END_ID = 2
#: Pieces of one length that one run should get.
RUN_ROWS = 200_000
#: Runs up to which the table of their first ranks is sent to all tasks (that of 10^11 pieces).
FEW_RUNS = 500_000
#: Characters on which both tokenizer libraries split alike; other texts go to the slower one.
PLAIN = re.compile(r"[\x00-\x7f\xa1-ɏ‐-‧‰-⁞€]*")


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> lists of ids by the tokenizers file at path (add_special_tokens=False).

    Where the same vocabulary lies beside it as tiktoken ranks, texts of plain characters go through
    that library, which gives the same ids about four times as fast (tests compare them).
    """
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    try:
        import base64

        import public_tokenizers
        import tiktoken

        if not path.endswith("byte_bpe_50k.json"):
            raise FileNotFoundError(path)
        with open(path[: -len("json")] + "tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, FileNotFoundError):
        quick = None

    def encode(texts: list[str]) -> list[list[int]]:
        if quick is None:
            return [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]
        return [quick.encode_ordinary(t) if PLAIN.fullmatch(t) and not any(s in t for s in special) else full.encode(t, add_special_tokens=False).ids for t in texts]

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents of over max_tokens are cut, and only their first piece is shorter."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        import zlib

        encode = encoder(tokenizer)
        for batch in slices(batches):
            ids, out = batch.column("doc_id").to_pylist(), [[], [], [], [], []]
            for doc, tokens in zip(ids, encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                raw = np.array([*tokens, END_ID], "<u4")
                n = len(raw)
                cuts = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(raw[a:b].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return plain_keys(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: tuple[float, float, float], rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Vector best-fit decreasing over a histogram {length: pieces}.

    Returns classes (number of bins, [(length, how many in each bin), ...]). A length goes, as often as
    it fits, to the feasible class that scores best: the largest weighted dot product of demand and
    residual taken over the bin's whole residual ('dot': how well the piece uses up what is left), or
    the smallest weighted norm of what would remain ('norm'). Every capacity binds; new bins open only
    when no open bin has room.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    residual = np.zeros((0, 3))
    sizes = np.zeros(0, np.int64)
    content: list[tuple] = []
    for length in sorted(counts, reverse=True):
        left, need = counts[length], np.array([length, 1, float(length) * length])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacity}")
        new_r, new_s, new_c = [], [], []
        if len(residual):
            fits = np.floor((residual + 1e-9) / need).min(axis=1).astype(np.int64)
            open_ = np.flatnonzero(fits > 0)
            after = (residual[open_] - need * fits[open_, None]) / cap
            if rule == "norm":
                score = (w * after**2).sum(axis=1)
            else:
                share = residual[open_] / cap
                used = need * fits[open_, None] / cap
                score = -((w * used * share).sum(axis=1) / (w * share * share).sum(axis=1))
            drop = []
            for k in open_[np.argsort(score, kind="stable")]:
                if not left:
                    break
                per, bins = int(fits[k]), int(sizes[k])
                whole = min(bins, left // per)
                parts = [(whole, per)] if whole else []
                left -= whole * per
                if left and whole < bins:
                    parts.append((1, left))
                    whole, left = whole + 1, 0
                for n, m in parts:
                    new_r.append(residual[k] - need * m)
                    new_s.append(n)
                    new_c.append((*content[k], (length, m)))
                sizes[k] -= whole
                if not sizes[k]:
                    drop.append(k)
            if drop:
                keep = np.ones(len(sizes), bool)
                keep[drop] = False
                residual, sizes = residual[keep], sizes[keep]
                content = [c for c, x in zip(content, keep, strict=True) if x]
        if left:
            per = int(np.floor((cap + 1e-9) / need).min())
            for n, m in ((left // per, per), (1, left % per)):
                if n and m:
                    new_r.append(cap - need * m)
                    new_s.append(n)
                    new_c.append(((length, m),))
        if new_s:
            residual = np.vstack([residual, new_r])
            sizes = np.concatenate([sizes, new_s])
            content += new_c
    return [(int(n), list(c)) for n, c in zip(sizes, content, strict=True)]


def slot_table(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, per bin, offset of the first copy) of a best_fit result."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for bins, content in plan:
        at = 0
        for length, per in content:
            begin = taken.get(length, 0)
            rows.append((length, begin, begin + bins * per, base, per, at))
            taken[length] = begin + bins * per
            at += length * per
        base += bins
    return rows


def pack(pieces: DataFrame, max_tokens: int = 1024, max_docs: int = 1024, max_attention: float | None = None, rule: str = "dot", weights: tuple[float, float, float] = (1.0, 0.25, 0.25)) -> DataFrame:
    """pieces (with a long column `length` of 1..max_tokens) plus sequence_id and offset.

    The plan sent to the executors has at most a few rows for each of the max_tokens lengths, and a row for
    every RUN_ROWS pieces.
    """
    spark = pieces.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("_piece")
    stored = written(pieces.select(whole, F.col("length").cast("long").alias("_length"), F.monotonically_increasing_id().alias("_row")), "pieces")
    capacity = (float(max_tokens), float(max_docs), float(max_attention if max_attention is not None else max_tokens * max_tokens))
    of_length = stored.groupBy("_length").agg(F.ceil(F.count(F.lit(1)) / RUN_ROWS).alias("_runs"))  # at most max_tokens rows
    salted = stored.join(F.broadcast(of_length), "_length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_runs"))).drop("_runs")
    runs = salted.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    found = runs.collect()  # at most max_tokens rows, and one more for every RUN_ROWS pieces
    counts: dict[int, int] = {}
    begins = []
    for r in sorted(found, key=lambda r: (r["_length"], r["_salt"])):
        begins.append((r["_length"], r["_salt"], counts.get(r["_length"], 0)))
        counts[r["_length"]] = counts.get(r["_length"], 0) + r["n"]
    slots = slot_table(best_fit(counts, capacity, rule, weights))
    starts = spark.createDataFrame(begins, "_length long, _salt long, _begin long")
    places = spark.createDataFrame(slots, "length long, _from long, _to long, _bin long, _per long, _at long")
    ranked = salted.join(F.broadcast(starts) if len(begins) <= FEW_RUNS else starts, ["_length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_begin") + F.row_number().over(Window.partitionBy("_length", "_salt").orderBy("_row")) - 1)
    out = ranked.join(F.broadcast(places), (F.col("_length") == F.col("length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    within = F.col("_rank") - F.col("_from")
    bin_, at = (F.col("_bin") + F.floor(within / F.col("_per"))).cast("long"), (F.col("_at") + F.pmod(within, F.col("_per")) * F.col("_length")).cast("long")
    return out.select("_piece.*", bin_.alias("sequence_id"), at.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, **limits) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, max_tokens), max_tokens, **limits)
