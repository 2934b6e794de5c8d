"""The index of inverted cells against brute force."""

import os

import numpy as np
import pytest

from derivia import queries
from derivia.operators import similar

SCHEMA = "id long, vector array<float>"


def clustered(n, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    lengths = rng.lognormal(0, 2, size=(n, 1))
    return ((centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, dims))) * lengths).astype(np.float32)


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, ids, q, k):
    v = vectors.astype(np.float64)
    d = 1 - (v * v[q]).sum(1) / np.sqrt((v * v).sum(1) * (v[q] * v[q]).sum())
    return [ids[x] for x in sorted(range(len(v)), key=lambda x: (d[x], ids[x]))[:k]]


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append(r["id"])
    return out


def share(got, vectors, ids, at, k):
    return np.mean([len(set(got[ids[i]]) & set(brute(vectors, ids, i, k))) / k for i in at])


@pytest.fixture(scope="module")
def vectors():
    return clustered(3000)


@pytest.fixture(scope="module")
def index(spark, vectors):
    return similar.indexed(frame(spark, vectors), "id", "vector", 12, k=10)


def test_finds_the_nearest_in_a_part_of_the_cells(spark, vectors, index):
    q = frame(spark, vectors[::30], range(0, 3000, 30)).withColumnRenamed("id", "q")
    rows = similar.nearest(index, q, "q", "vector", 10).collect()
    got = answers(similar.nearest(index, q, "q", "vector", 10))
    assert share(got, vectors, list(range(3000)), range(0, 3000, 30), 10) >= 0.9
    assert 1 <= index.probes < len(index.centres)
    assert len(rows) == len({(r["q"], r["rank"]) for r in rows}) == 1000
    assert all(abs(r["distance"]) < 1e-12 and r["id"] == r["q"] for r in rows if r["rank"] == 1)


def test_every_cell_gives_what_brute_force_gives(spark, vectors, index):
    from dataclasses import replace

    q = frame(spark, vectors[::300], range(0, 3000, 300)).withColumnRenamed("id", "q")
    got = answers(similar.nearest(replace(index, probes=len(index.centres)), q, "q", "vector", 10))
    assert got == {i: brute(vectors, list(range(3000)), i, 10) for i in range(0, 3000, 300)}


def test_changes_are_layers_of_the_index(spark, vectors, index):
    ids = [*range(100, 3000), *range(5000, 5200)]
    new = clustered(200, seed=9)
    moved = vectors.copy()
    moved[100:150] = clustered(50, seed=11)
    changes = frame(spark, np.vstack([moved[100:150], new]), [*range(100, 150), *range(5000, 5200)])
    gone = spark.createDataFrame([(i, None) for i in range(90)], SCHEMA).select("id")
    unusable = spark.createDataFrame([(i, None if i % 2 else [0.0] * 12) for i in range(90, 100)], SCHEMA)
    later = similar.changed(index, changes.union(unusable), "vector", gone)
    assert len(later.rows.changes) == 1 and later.rows.changes[0].n == 350
    now = np.vstack([moved[100:], new])
    assert sorted(r["id"] for r in later.read().select("id").collect()) == ids
    at = list(range(0, len(ids), 31))
    got = answers(similar.nearest(later, frame(spark, now[at], [ids[i] for i in at]).withColumnRenamed("id", "q"), "q", "vector", 10))
    assert share(got, now, ids, at, 10) >= 0.9


def test_a_hot_cell_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 50)
    monkeypatch.setattr(similar, "BLOCK_QUERIES", 20)
    same = np.vstack([np.ones((400, 4)), np.eye(4)]).astype(np.float32)
    rows = frame(spark, same)
    index = similar.indexed(rows, "id", "vector", 4, k=5)
    got = answers(similar.nearest(index, rows.withColumnRenamed("id", "q"), "q", "vector", 5))
    assert all(got[i] == [0, 1, 2, 3, 4] for i in range(400))
    assert all(got[400 + i][0] == 400 + i for i in range(4))


def test_odd_vectors_take_no_part(spark):
    odd = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [0.0, 2.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame(odd, SCHEMA).selectExpr("id", "vector", "id AS cell", "'x' AS distance", "1 AS rank")
    index = similar.indexed(rows, "id", "vector", 2, k=3)
    got = answers(similar.nearest(index, rows.withColumnRenamed("id", "q"), "q", "vector", 3))
    assert got == {1: [1, 9], 9: [9, 1]}


def test_an_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    index = similar.indexed(rows, "id", "vector", 2)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vector array<float>")
    assert similar.nearest(index, q, "q", "vector").collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables aren't here")
def test_the_query_on_whole_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    vectors, ids = np.array([r["embedding"] for r in rows]), [r["vec_id"] for r in rows]
    at = [i for i, x in enumerate(ids) if x % 100 == 0]
    got = answers(queries.q_similar_index(spark, "/root/testdata/sf0.1").selectExpr("query_id AS q", "rank", "vec_id AS id", "distance"))
    assert sorted(got) == [ids[i] for i in at] and {len(x) for x in got.values()} == {20}
    assert share(got, vectors, ids, at, 20) >= 0.9
