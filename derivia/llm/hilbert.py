"""Nearest neighbours by inner product through shifted space-filling curves.

Vectors are lifted to equal length (one more coordinate), so that the largest inner product is the
smallest distance. That is done by classes of length (each goes down to half of its longest, thin ones
side by side are one), so that a few long vectors don't gather all others in one spot; a query looks
into every class. Each of several curves rotates them onto a few random directions, shifts the grid and
takes their place on a Hilbert curve. Spark range-partitions every curve by key; a row's rank there
gives its block, and a query meets the rows of its own block and of those beside it.
The best k of each window are merged over the curves and reranked by the exact inner product.

How wide the windows are is measured in the job: the true neighbours of at most SAMPLE queries are
found among all rows, and from their places on the curves follows the recall of any width. Windows
start at three blocks of `block` rows; blocks double up to WIDEST times that, and then more blocks on
either side are met, until the sample's recall is `target` or more. The rule is the same at every size,
and so is the number of curves. No task holds more than a block's rows and MOST_QUERIES queries: where
more meet a block, they are dealt out and meet copies of its rows.

Work and traffic are (curves x rows) for the orderings, (SAMPLE x rows) for the measurement and (curves
x queries x window) for the windows. Where neighbours lie near each other on the curves, windows stay
as they are when a table grows; in vectors without structure they grow with it, so that the work grows
with the square of the table. Classes are as many as the lengths have
bands, and at most two for every block of rows. Equal vectors go through the curves once, with the k + 1 smallest ids
that any result can hold; a vector that a third of all rows share fills no window.

Defined cases: null, zero-length or all-zero vectors, those with null or non-finite components and rows
without an id take no part; neither do vectors of another dimension than the most common one (the
larger of two as common); rows of an equal id and vector count once, a query is never its own result;
equal scores go by ascending id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from derivia.llm.common import Scratch, fits_broadcast, plain_keys, written

log = logging.getLogger(__name__)

CURVES = 10
BLOCK = 128
DIMS = 8
BITS = 7
TARGET = 0.95
#: Queries whose true neighbours are sought; a quarter of a thousand of 20 tell recall to about half a hundredth.
SAMPLE = 256
#: A block is at most so many times the least one, as a task holds it and its scores.
WIDEST = 256
#: Queries that a task meets a block's rows with; about as many, as they are dealt out by a hash.
MOST_QUERIES = 4096
#: Rows of the table of hot blocks up to which it is sent to all tasks.
FEW_BLOCKS = 100_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (unsigned, below 2**bits), by untangling axes bit by bit."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, np.uint32(0)) ^ swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint32(1 << b)) != 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint32(b) & np.uint32(1)).astype(np.uint64)
    return key


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def curve_frame(curve: int, dim: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions and the grid shift of a curve."""
    rng = np.random.default_rng([seed, curve])
    axes = np.linalg.qr(rng.normal(size=(dim, min(dims, dim))))[0]
    return axes, rng.uniform(0, 1, axes.shape[1])


def length_classes(bands: list[tuple[int, int, float]], least: int) -> tuple[dict[int, int], list[float]]:
    """Bands (number, rows, largest square of a length) to the class of each band and, by class, the largest square.

    Neighbouring bands of under `least` rows are one class until it has `least` rows.
    """
    class_of, longest, rows = {}, [], []
    thin = False
    for band, n, square in sorted(bands):
        if not (thin and n < least and rows[-1] < least):
            longest.append(square)
            rows.append(0)
        thin = n < least
        class_of[band] = len(rows) - 1
        rows[-1] += n
        longest[-1] = max(longest[-1], square)
    return class_of, longest


def true_neighbours(reps: DataFrame, sample: list, k: int, dim: int) -> DataFrame:
    """(q, r, score, ids): the k + 1 representatives of the largest product with each of a bounded sample (rep, v) of queries, among all rows."""
    asked, mine = np.array([s["rep"] for s in sample]), np.array([s["v"] for s in sample], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, count = np.zeros((len(mine), 0)), np.zeros((len(mine), 0), np.int64), np.zeros((len(mine), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = mine @ matrix(batch.column("v"), dim).T
            score = np.hstack([score, found])
            ids, count = (np.hstack([kept, np.broadcast_to(batch.column(c).to_numpy(), found.shape)]) for kept, c in ((ids, "rep"), (count, "n")))
            if score.shape[1] > k + 1:
                top = np.argpartition(-score, k, axis=1)[:, : k + 1]
                score, ids, count = (np.take_along_axis(x, top, 1) for x in (score, ids, count))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, score.shape[1])), pa.array(ids.ravel()), pa.array(score.ravel()), pa.array(count.ravel())], ["q", "r", "score", "n"])

    best = reps.select("rep", "v", F.size("ids").cast("long").alias("n")).mapInArrow(scan, "q long, r long, score double, n long")
    return best.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))).where(F.col("at") <= k + 1)


def true_pairs(found: list, k: int) -> dict[tuple[int, int], int]:
    """(q, r) to the number of r's ids among the k true neighbours of q; a query's own id isn't one."""
    pairs, left = {}, {}
    for row in sorted(found, key=lambda x: (x["q"], x["at"])):
        taken = min(row["n"] - (row["q"] == row["r"]), left.setdefault(row["q"], k))
        left[row["q"]] -= taken
        if taken:
            pairs[row["q"], row["r"]] = taken
    return pairs


def reaching(there: np.ndarray, mine: np.ndarray, weight: np.ndarray, block: int, target: float) -> tuple[int, int, float]:
    """Rows of a block, blocks on either side and recall of the first windows that find `target` of the pairs; places are (pairs, curves)."""
    wide, radius = block, 1
    while True:
        met = (np.abs(there // wide - mine // wide) <= radius).any(1)
        recall = float(weight[met].sum() / weight.sum())
        if recall >= target:
            return wide, radius, recall
        wide, radius = (2 * wide, 1) if wide < WIDEST * block else (wide, radius + 1)


def neighbours(vectors: DataFrame, query: F.Column, k: int = 20, curves: int = CURVES, block: int = BLOCK, dims: int = DIMS, bits: int = BITS, seed: int = 7, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) that satisfies `query` (a condition on vec_id), its k nearest found."""
    base = plain_keys(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.where(fine)
    common = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim = common["dim"]
    base = base.where(F.size("v") == dim)

    # equal vectors: one representative and the ids that any result can hold, pre-aggregated in blocks of ids
    ids = base.select("vec_id", "v", F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).distinct()
    smallest = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    part = ids.withColumn("at", F.row_number().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    part = part.groupBy("h", "v", "salt").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = part.groupBy("h", "v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")
    work = Scratch()
    reps = work.written(reps, "reps")
    asked = written(base.where(query).select("vec_id", "v", F.xxhash64("v").alias("h")).distinct().join(reps.select(F.xxhash64("v").alias("h"), F.col("v").alias("w"), "rep"), "h").where("v = w").select(F.col("vec_id").alias("query_id"), "rep"), "asked")
    wanted = reps.join(asked.select("rep").distinct().withColumn("asked", F.lit(True)), "rep", "left").select("rep", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
    top = reps.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]  # squares of components over this can't overflow
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    most = reps.agg(F.max(square)).first()[0]
    # a band goes down to half of its longest, from the longest of all; what has no square left in double precision is in the last
    wanted = wanted.withColumn("square", square).withColumn("band", F.when(F.col("square") > 0, F.floor(F.log2(most / F.greatest("square", F.lit(1e-300))) / 2)).otherwise(1000).cast("int"))
    wanted = work.written(wanted, "wanted")
    bands = [tuple(r) for r in wanted.groupBy("band").agg(F.count(F.lit(1)), F.max("square")).collect()]  # some hundred at most
    class_of, longest = length_classes(bands, block)

    def keyed(batches):
        spread = 3 / (dim + 1) ** 0.5  # three deviations of a random direction either way
        for batch in batches:
            x = matrix(batch.column("v"), dim) / top
            own = np.array([class_of[b] for b in batch.column("band").to_pylist()], np.int64)
            squares = batch.column("square").to_numpy()
            reach = np.array(longest)[own]
            # a candidate is lifted onto the sphere of its class, a query is stretched onto it: the nearest on the sphere has the largest product
            safe = lambda y: np.sqrt(np.where(y > 0, y, 1))[:, None]
            there = np.hstack([x, np.sqrt(np.maximum(reach - squares, 0))[:, None]]) / safe(reach)
            queries = np.flatnonzero(np.asarray(batch.column("asked")))
            mine = np.hstack([x, np.zeros((len(x), 1))])[queries] / safe(squares[queries])
            for c in range(curves):
                axes, shift = curve_frame(c, dim + 1, dims, seed)
                grid = lambda y: np.clip(((y @ axes / spread + 1) / 3 + shift / 3) * (1 << bits), 0, (1 << bits) - 1).astype(np.uint32)  # noqa: B023, E731
                keys, asked_keys = (hilbert_keys(grid(y), bits).view(np.int64) for y in (there, mine))
                for g in range(len(longest)):
                    here = np.flatnonzero(own == g)
                    for rows, key, is_query in ((here, keys[here], False), (queries, asked_keys, True)):
                        if len(rows):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g * curves + c, np.int32)), pa.array(key), batch.column("rep").take(pa.array(rows)), pa.array(np.full(len(rows), is_query)), batch.column("v").take(pa.array(rows))], ["curve", "key", "rep", "is_query", "v"])

    parts = max(1, int(spark_parts(vectors)))
    keys = wanted.select("rep", "v", "asked", "square", "band").mapInArrow(keyed, "curve int, key long, rep long, is_query boolean, v array<double>")
    order = ["curve", "key", "rep", "is_query"]
    placed = keys.withColumn("v", F.col("v").cast("array<float>") if floats(vectors) else F.col("v"))
    placed = work.written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "curves")
    counts = placed.groupBy("curve", "part").agg(F.sum(F.when(~F.col("is_query"), 1).otherwise(0)).alias("n"))
    starts = counts.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("begin"))
    # a few rows for each partition; the join is on both
    at = F.sum(F.when(~F.col("is_query"), 1).otherwise(0)).over(Window.partitionBy("curve", "part").orderBy("row")) - F.when(~F.col("is_query"), 1).otherwise(0)
    located = placed.withColumn("at", at).join(starts, ["curve", "part"]).withColumn("at", F.col("begin") + F.col("at")).drop("part", "row", "begin", "key")
    wide, radius, recall = fitted(located, reps, asked, k, curves, block, dim, target)
    log.info("windows of %d x %d rows on %d curves of %d classes, recall of the sample %.4f", 2 * radius + 1, wide, curves, len(longest), recall)
    cells = dealt(located.withColumn("block", F.floor(F.col("at") / wide)).drop("at"), radius)

    def windows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_query = np.asarray(table.column("is_query"))
        x, ids = matrix(table.column("v"), dim), table.column("rep").to_numpy()
        rows, asked_rows = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        if not len(rows):
            return
        for at in np.array_split(asked_rows, max(1, len(asked_rows) * max(1, len(rows) // 4096) // 256)):
            if not len(at):
                continue
            score = x[at] @ x[rows].T
            # more than k, as the query's own vector may be among them
            top = np.argpartition(-score, k, axis=1)[:, : k + 1] if len(rows) > k + 1 else np.tile(np.arange(len(rows)), (len(at), 1))
            m = top.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], m)), pa.array(ids[rows][top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel())], ["q", "r", "score"])

    met = cells.groupBy("curve", "block", "salt").applyInArrow(windows, "q long, r long, score double")
    best = met.groupBy("q", "r").agg(F.max("score").alias("score"))
    best = best.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))).where(F.col("at") <= k + 1).drop("at")
    out = ranks(best, reps, asked, k)
    work.drop()
    return out


def dealt(placed: DataFrame, radius: int, most: int = MOST_QUERIES) -> DataFrame:
    """Rows (curve, block, is_query, rep, v) to the cells (curve, block, salt) in which they meet: queries go to the blocks beside theirs, too; a block that more than `most` queries meet has several cells, with all its rows in each."""
    beside = F.sequence(F.col("block") - radius, F.col("block") + radius)
    asked = placed.where("is_query").select(*[c for c in placed.columns if c != "block"], F.explode(beside).alias("block"))
    hot = written(asked.groupBy("curve", "block").count().where(F.col("count") > most).select("curve", "block", F.ceil(F.col("count") / most).cast("int").alias("salts")), "hot")
    if fits_broadcast(hot, FEW_BLOCKS):
        hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    rows = placed.where("not is_query").join(hot, ["curve", "block"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    asked = asked.join(hot, ["curve", "block"], "left").withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    columns = ["curve", "block", "salt", "is_query", "rep", "v"]
    return rows.select(*columns).union(asked.select(*columns))


def fitted(located: DataFrame, reps: DataFrame, asked: DataFrame, k: int, curves: int, block: int, dim: int, target: float) -> tuple[int, int, float]:
    """The windows that reach the target on a bounded sample of the queries, from the places (curve, rep, is_query, at) on the curves of each class (numbers from class x curves on)."""
    drawn = asked.select("rep").distinct().orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE)
    sample = reps.join(F.broadcast(drawn), "rep").select("rep", "v").collect()
    pairs = true_pairs(true_neighbours(reps, sample, k, dim).collect(), k) if sample else {}
    if not pairs:
        return block, 1, 1.0
    ends = {(q, True) for q, _ in pairs} | {(r, False) for _, r in pairs}
    few = located.sparkSession.createDataFrame(sorted(ends), "rep long, is_query boolean")
    place = {(x["rep"], x["is_query"], x["curve"]): x["at"] for x in located.select("curve", "rep", "is_query", "at").join(F.broadcast(few), ["rep", "is_query"]).collect()}
    class_of = {rep: curve // curves for rep, is_query, curve in place if not is_query}
    on = lambda rep, is_query, g: [place[rep, is_query, g * curves + c] for c in range(curves)]
    return reaching(np.array([on(r, False, class_of[r]) for _, r in pairs]), np.array([on(q, True, class_of[r]) for q, r in pairs]), np.array(list(pairs.values())), block, target)


def ranks(best: DataFrame, reps: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Candidates (q, r: representatives) to the k nearest ids of each query, scored anew on the original vectors."""
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = best.join(reps.select(F.col("rep").alias("q"), F.col("v")), "q").join(reps.select(F.col("rep").alias("r"), F.col("v").alias("w"), "ids"), "r")
    scored = written(scored.select("q", "ids", dot.alias("score")), "scored")
    out = asked.select("query_id", F.col("rep").alias("q")).join(scored, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def spark_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def floats(df: DataFrame) -> bool:
    """Whether the vectors are stored in single precision, so that this loses nothing on the way."""
    return dict(df.dtypes).get("embedding") == "array<float>"
