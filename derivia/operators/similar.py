"""Nearest rows of a vector column for many queries at once, through an index of inverted cells.

Cells are the centres of a k-means that is fitted on a sample of at most SAMPLE rows; every row lies in the
cell of its nearest centre. A query looks into its nearest cells, as many as a measurement against brute force
asks for, and what it finds there is ranked by the exact cosine distance. Changed rows are layers over the
index, as in the engine's state, and a cell that holds or is asked much is dealt in blocks over the tasks.

Defined cases: vectors that are null, of another length than the index, of length zero, or with a null or
non-finite component take no part, as rows and as queries; ties go to the smaller key; a query that is a row
finds itself; with fewer than k rows in its cells a query gets these; an empty table gives an index without
cells and empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derivia.plans.state import Layer, Layers, counted

#: Rows that the cells are fitted on, at most.
SAMPLE = 32_768
MOST_CELLS = 2_048
#: Queries whose neighbours are found by brute force, to tell how many cells a query must look into.
MEASURED = 256
#: Rows, and queries, of a cell that meet in one task, about.
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024
#: Rows whose distances to all centres are held at once.
SLICE = 1_024


@dataclass(frozen=True)
class Index:
    """key and dimensions of the vectors, centres of the cells (of length 1), the rows (key, cell, vector), and the cells that a query looks into."""

    key: str
    dimensions: int
    centres: np.ndarray
    rows: Layers
    probes: int = 1

    def read(self) -> DataFrame:
        return self.rows.read((self.key,))


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has a direction: the sum of its squares is above zero and finite."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(vector) == dimensions) & (squares > 0) & (squares < float("inf")), F.lit(False))


def picked(rows: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    return rows.select(F.col(key), F.col(vector).alias("vector")).where(F.col(key).isNotNull()).where(usable(F.col("vector"), dimensions))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def with_cells(rows: DataFrame, key: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """rows(key, vector) as (key, cell, vector), once for each of the `probes` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS rows at most
    kinds = dict(rows.dtypes)

    def place(batches):
        centres = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                near = units(matrix(part.column("vector"), centres.shape[1])) @ centres.T
                cells = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(part.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(cells.ravel(), pa.int32()), part.column("vector").take(pa.array(row))], [key, "cell", "vector"])

    return rows.select(key, "vector").mapInArrow(place, f"`{key}` {kinds[key]}, cell int, vector {kinds['vector']}")


def indexed(rows: DataFrame, key: str, vector: str, dimensions: int, k: int = 20, recall: float = 0.95) -> Index:
    """An index over all rows, looking into as many cells as find this share of the k nearest."""
    usables = picked(rows, key, vector, dimensions)
    sample = counted(usables.orderBy(F.xxhash64(key), key).limit(SAMPLE), "sample")
    n = sample.n if sample.n < SAMPLE else usables.count()
    centres = np.zeros((0, dimensions))
    if n:
        # the root of the rows, with sixteen of the sample for each
        cells = max(1, min(MOST_CELLS, isqrt(n), sample.n // 16))
        features = sample.rows.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        fitted = KMeans(k=cells, distanceMeasure="cosine", maxIter=10, seed=1).fit(features).clusterCenters() if cells > 1 else [np.ones(dimensions)]
        centres = units(np.array([c for c in fitted if np.any(c)]))
    base = with_cells(usables, key, centres) if n else usables.select(key, F.lit(0).alias("cell"), "vector")
    return measured(Index(key, dimensions, centres, Layers(counted(base, "rows"))), k, recall)


def changed(index: Index, rows: DataFrame, vector: str, gone: DataFrame | None = None) -> Index:
    """The index with these rows in place of those with their keys, and without the keys of `gone`; rows whose vectors take no part leave."""
    key, layer = index.key, index.rows
    if not len(index.centres):
        raise ValueError("an index without cells is built anew")
    new = picked(rows, key, vector, index.dimensions)
    marked = with_cells(new, key, index.centres).withColumn("_gone", F.lit(False))
    leave = rows.where(F.col(key).isNotNull()).where(~usable(F.col(vector), index.dimensions)).select(key)
    if gone is not None:
        leave = leave.union(gone.select(key)).distinct().join(new.select(key), key, "left_anti")
    empty = F.lit(None)
    marked = marked.union(leave.select(key, empty.cast("int"), empty.cast(dict(marked.dtypes)["vector"]), F.lit(True)))
    return replace(index, rows=layer.with_change((key,), counted(marked, "rows")))


def best(rows: pa.Table | pa.RecordBatch, asks: pa.Table, key: str, dimensions: int, k: int) -> pa.Table:
    """The k nearest of the rows for each query: _query, key, cell, distance."""
    r, q = matrix(rows.column("vector"), dimensions), matrix(asks.column("vector"), dimensions)
    ids = rows.column(key).to_pylist()
    squares, near = (r * r).sum(axis=1), units(q) @ units(r).T if len(r) and len(q) else None
    whose, which, far = [], [], []
    for i in range(len(q) if len(r) else 0):
        s = near[i]
        # what may be among the k nearest, and then exactly: equal vectors have equal distances
        c = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9) if len(s) > k else np.arange(len(s))
        d = 1 - (r[c] * q[i]).sum(axis=1) / np.sqrt(squares[c] * (q[i] * q[i]).sum())
        for distance, _, at in sorted(zip(d.tolist(), [ids[x] for x in c], c.tolist(), strict=True))[:k]:
            whose.append(i)
            which.append(at)
            far.append(distance)
    whose, which = pa.array(whose, pa.int64()), pa.array(which, pa.int64())
    return pa.table([asks.column("_query").take(whose), rows.column(key).take(which), rows.column("cell").take(which), pa.array(far, pa.float64())], ["_query", key, "cell", "distance"])


def found(rows: DataFrame, query_type: str, key: str) -> str:
    return f"_query {query_type}, `{key}` {dict(rows.dtypes)[key]}, cell int, distance double"


def ranked(pairs: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("_query").orderBy("distance", key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """By brute force, for a few queries(_query, vector), which go to all tasks: _query, rank, key, cell, distance."""
    few = queries.limit(MEASURED).toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(few)
    key, dimensions = index.key, index.dimensions

    def meet(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                yield from best(batch.slice(start, BLOCK_ROWS), shared.value, key, dimensions, k).to_batches()

    rows = index.read()
    return ranked(rows.mapInArrow(meet, found(rows, dict(queries.dtypes)["_query"], key)), key, k)


def measured(index: Index, k: int = 20, recall: float = 0.95) -> Index:
    """The index with the fewest probes that find this share of the k nearest other rows, by MEASURED rows as queries."""
    key, cells = index.key, len(index.centres)
    if not cells:
        return index
    queries = counted(index.read().orderBy(F.xxhash64(key, F.lit(1)), key).limit(MEASURED).select(F.col(key).alias("_query"), "vector"), "queries").rows
    asked = queries.toArrow()
    order = np.argsort(-(units(matrix(asked.column("vector"), index.dimensions)) @ index.centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(order), 0), 1)
    at = {x: i for i, x in enumerate(asked.column("_query").to_pylist())}
    # MEASURED times k rows at most
    ranks = sorted(int(place[at[r["_query"]], r["cell"]]) for r in exact(index, queries, k + 1).where(F.col("_query") != F.col(key)).collect())
    return replace(index, probes=ranks[min(len(ranks), int(np.ceil(recall * len(ranks)))) - 1] + 1 if ranks else 1)


def nearest(index: Index, queries: DataFrame, query: str, vector: str, k: int = 20) -> DataFrame:
    """The k nearest rows found for each of queries(query, vector): query, rank, key, distance; queries are told apart by `query`."""
    key, dimensions = index.key, index.dimensions
    kind = dict(queries.dtypes)[query]
    asks = picked(queries.withColumnRenamed(query, "_query"), "_query", vector, dimensions)
    rows = index.read()
    columns = [F.col("_query").alias(query), "rank", key, "distance"]
    if not len(index.centres):
        return asks.join(rows.select(key), F.lit(False)).select(F.col("_query").alias(query), F.lit(1).alias("rank"), key, F.lit(0.0).alias("distance"))
    asks = counted(with_cells(asks, "_query", index.centres, index.probes), "asks").rows
    # a row for each cell
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    loads = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    plan = F.broadcast(counted(sizes.join(loads, "cell"), "cells").rows)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(plan, "cell").select(key, "cell", "vector", dealt(key, "parts").alias("part"), every("blocks").alias("block"))
    right = asks.join(plan, "cell").select("_query", "cell", "vector", dealt("_query", "blocks").alias("block"), every("parts").alias("part"))

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        return best(rows, asks, key, dimensions, k)

    by = ("cell", "part", "block")
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, found(rows, kind, key))
    return ranked(pairs, key, k).select(*columns)
