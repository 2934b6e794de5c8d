"""Ranked lexical search, score at a time over impact-ordered postings.

Documents are tokenised once for a block of items (the queries): an index row holds a document's length and
its counts of the block's terms. Spark counts N, L and each term's documents over the whole index. Then every
task builds impact-ordered postings for shards of its rows: a term's postings by falling impact. For an item
the groups of equal impact of all its terms are taken in falling order, and added to the scores so far. It
stops only when bounds prove which documents can be among the best: what is left of every term's impacts can
lift no other to the lowest of them. Their scores are then completed from the index rows, and exact. A task
keeps the best of each item and carries the lowest on as a bound; Spark merges the tasks' few rows.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and its impact on a document
weight * (10^9 tf div (1000 tf + 8 m)) with m = 10 + 90 n N div L, in whole numbers.

Items come in blocks of at most about BLOCK_PAIRS terms, for any number of items; what goes to the driver and
to the tasks is a block's terms. Terms are told apart by 64-bit hashes.

Defined cases: a null or empty text has no terms, and such a document isn't counted; every row is a document,
so repeated rows are ranked each; equal scores go by ascending doc_id, a null id after all others; the rows of
an item_id are one item with the terms of all of them, and rows without one are left out; an item without
terms in any document gives no rows; a very long text is one row like any other, read whole (its arrays take
some 50 bytes per byte); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from derivia.llm.common import U64, Scratch, Words, list_array, plain_keys, slices, small_batches

#: Bytes that stand between terms: all of ASCII but digits and letters.
APART = np.arange(256) < 128
APART[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
#: Pairs of item and term in a block, on average.
BLOCK_PAIRS = 1 << 18
#: Documents, or postings, after which a task closes a shard.
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 1 << 21
#: Id that stands for null inside a task: after all others.
NO_ID = np.iinfo(np.int64).max
#: Parts in which an item's rows from the tasks are merged first.
MERGE_PARTS = 32


def terms_of(column: pa.Array) -> Words:
    return Words(column, lower=True, apart=APART)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each, the term as the hash of its bytes."""
    items = plain_keys(items, "item_id", "text").where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        for batch in slices(batches):
            w = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(w.row)), pa.array(w.hashes().view(np.int64))], ["item_id", "term"])

    return items.mapInArrow(run, "item_id long, term long").distinct()


def indexed(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n, and places in the (sorted) vocabulary with their counts, for each document that has a term."""
    docs = plain_keys(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        for batch in slices(batches):
            w = terms_of(batch.column("text"))
            h, rows = w.hashes(), len(w.per_row)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            key, tf = np.unique(w.row[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
            per = np.bincount(key // len(vocabulary), minlength=rows)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.per_row.astype(np.int64)), list_array((key % len(vocabulary)).astype(np.int32), per, pa.int32()), list_array(tf.astype(np.int64), per, pa.int64())], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(w.per_row > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Some documents: their rows as in the index, and the postings of each term by falling impact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, term: np.ndarray, part: np.ndarray, vocabulary: int):
        """part: a posting's impact without its term's weight; rows: where each document's postings begin, and the end."""
        self.ids, self.rows, self.term, self.part = ids, rows, term, part
        order = np.lexsort((-part, term))
        self.docs = np.repeat(np.arange(len(ids)), np.diff(rows))[order]
        self.falling = -part[order]
        self.lists = np.searchsorted(term[order], np.arange(vocabulary + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the k best (equal scores included) of those with a score of `least` or more, and their exact scores."""
        at, ends = self.lists[terms], self.lists[terms + 1]
        some = (at < ends) & (weights[terms] > 0)
        terms, at, ends = terms[some], at[some].copy(), ends[some]
        w = weights[terms]
        heads = w * -self.falling[at]  # the largest impact left of each term
        score = np.zeros(len(self.ids), np.int64)
        while True:
            rest = int(heads.sum())
            lowest = max(least, int(np.partition(score, -k)[-k]) if len(score) >= k else 0)
            if not rest or rest < lowest:  # no document that hasn't been met can get there
                found = np.flatnonzero((score > 0) & (score + rest >= lowest))
                if not rest:
                    return found, score[found]
                if len(found) <= k:
                    break
            level = max(1, int(heads.max()) * 3 // 4)
            for i in np.flatnonzero(heads >= level):
                end = at[i] + np.searchsorted(self.falling[at[i] : ends[i]], level // -w[i], "right")
                score[self.docs[at[i] : end]] -= w[i] * self.falling[at[i] : end]
                at[i] = end
                heads[i] = -w[i] * self.falling[end] if end < ends[i] else 0
        return found, np.array([self.full(x, terms, weights) for x in found], np.int64)

    def full(self, doc: int, terms: np.ndarray, weights: np.ndarray) -> int:
        """The score of one document from its index row."""
        own = slice(self.rows[doc], self.rows[doc + 1])
        mine = np.isin(self.term[own], terms)
        return int((weights[self.term[own]] * self.part[own])[mine].sum())


def shards(batches, documents: int, length: int, vocabulary: int):
    """Shards of index rows."""
    ids, n, term, tf, per = [], [], [], [], []

    def closed() -> Shard:
        counts = np.concatenate(per)
        m = 10 + 90 * np.concatenate(n) * documents // length
        t = np.concatenate(tf)
        out = Shard(np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)]), np.concatenate(term), 10**9 * t // (1000 * t + 8 * np.repeat(m, counts)), vocabulary)
        for x in (ids, n, term, tf, per):
            x.clear()
        return out

    for batch in batches:
        ids.append(np.asarray(batch.column("doc_id").fill_null(NO_ID)))
        n.append(np.asarray(batch.column("n")))
        lists = batch.column("terms")
        term.append(np.asarray(lists.flatten()))
        tf.append(np.asarray(batch.column("tfs").flatten()))
        per.append(np.diff(np.asarray(lists.offsets)))
        if sum(map(len, ids)) >= SHARD_DOCS or sum(map(len, term)) >= SHARD_POSTINGS:
            yield closed()
    if ids:
        yield closed()


def best_rows(index: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task and item."""

    def run(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in shards(batches, documents, length, len(weights)):
            for item, terms in items:
                ids, scores = kept.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                found, new = shard.best(terms, weights, k, int(scores[-1]) if len(scores) == k else 0)
                if len(found):
                    ids, scores = np.concatenate([ids, shard.ids[found]]), np.concatenate([scores, new])
                    first = np.lexsort((ids, -scores))[:k]
                    kept[item] = ids[first], scores[first]
        if kept:
            ids = np.concatenate([x for x, _ in kept.values()])
            item = np.repeat(np.array(list(kept), np.int64), [len(x) for x, _ in kept.values()])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([x for _, x in kept.values()]))], ["item_id", "doc_id", "score"])

    return index.where(F.size("terms") > 0).mapInArrow(run, "item_id long, doc_id long, score long")


def block(docs: DataFrame, pairs: list[tuple[int, int]], k: int, work: Scratch) -> DataFrame:
    """item_id, rank, doc_id, score for one block's pairs of item and term."""
    item = np.array([p[0] for p in pairs], np.int64)
    vocabulary, place = np.unique(np.array([p[1] for p in pairs], np.int64).view(U64), return_inverse=True)
    order = np.lexsort((place, item))
    ids, begin = np.unique(item[order], return_index=True)
    items = list(zip(ids.tolist(), np.split(place[order], begin[1:]), strict=True))
    index = work.written(indexed(docs, vocabulary), "index")
    total = index.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(1)).alias("length")).first()
    documents, length = total["documents"], total["length"]
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a block's terms
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    best = best_rows(index, items, weights, documents, length, k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS))
    best = best.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("at") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return best.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents with a score above 0 for each row group of items(item_id, text)."""
    spark, work, out = docs.sparkSession, Scratch(), None
    small_batches(spark)
    pairs = work.written(item_terms(items), "pairs")
    n = pairs.count()
    blocks = -(-n // block_pairs)
    for b in range(blocks):
        # an item's terms stay together; a block has block_pairs of them on average
        mine = [tuple(r) for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        if mine:
            files = Scratch()
            # ranks are few: written, so that the index can go
            part = work.written(block(docs, mine, k, files), "ranks")
            files.drop()
            out = part if out is None else out.union(part)
    work.drop(pairs)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def oracle() -> str:
    """The same in DuckDB SQL."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS terms FROM documents),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({words}) AS term FROM benchmark WHERE item_id IS NOT NULL)),
    t AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
    p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term),
    m AS (SELECT rid, doc_id, 10 + (90 * len(terms) * n_docs) // length AS m FROM d, t WHERE len(terms) > 0),
    s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
