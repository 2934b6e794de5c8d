"""Scans by chunks: the order, what they read, and scans that lose their copy."""

import datetime as dt

from pyspark.sql import functions as F

from derivia.operators import capture, scan
from derivia.plans.catalog import Catalog
from derivia.plans.state import State, deleted_path

NOW = dt.datetime(2026, 5, 3)


def started(spark, rows, pk, chunk):
    state, d = capture.declared(State.empty(spark), rows, "part", "size", pk, ("name",), "enum", prompt="p", model="m", schema=["s", "l"], config={"backfill_chunk": chunk})
    return state, d



def test_chunks_follow_the_key_and_read_the_copy_about_once(spark, monkeypatch):
    monkeypatch.setattr(scan, "LEAST_ROWS", 100)
    n, chunk = 20_000, 2_000
    rows = spark.range(n).select((n - F.col("id")).alias("a"), (F.col("id") % 3).cast("string").alias("b"), F.sha2(F.col("id").cast("string"), 512).alias("name"))
    state, d = started(spark, rows, ("a", "b"), chunk)
    seen, read, total = [], 0, None
    while d.backfill_pending:
        state, d, got = capture.backfill_step(state, d, rows, NOW)
        seen.append((got, d.backfill_cursor))
        if d.backfill_scan:
            part, _ = scan.chunk_of(spark, d.backfill_scan, d.backfill_scanned, chunk)
            total = sum(x[2] for x in d.backfill_scan["files"])
            if part is not None:
                names = {f.rsplit("/", 1)[1] for f in part.inputFiles()}
                read += sum(x[2] for x in d.backfill_scan["files"] if x[0] in names)
    assert [g for g, _ in seen] == [chunk] * 10 + [0] and [c[0] for _, c in seen[:10]] == [chunk * k for k in range(1, 11)]
    assert total == n and n <= read + chunk < 2 * n
    assert d.backfill_scan is None and d.backfill_scanned == n
    assert state.jobs.count() == state.jobs.select("row_key").distinct().count() == n


def test_a_scan_without_its_copy_goes_on_from_the_cursor(spark):
    rows = spark.range(25).select(F.col("id"), F.concat(F.lit("x"), "id").alias("name"))
    state, d = started(spark, rows, ("id",), 10)
    state, d, _ = capture.backfill_step(state, d, rows, NOW)
    state = State(Catalog.from_json(state.catalog.to_json()), state.jobs, state.results, state.spend, state.cells, state.seq)
    d = state.catalog.by_id(1)
    assert d.backfill_cursor == (9,) and d.backfill_scanned == 10
    deleted_path(spark, d.backfill_scan["path"])
    while d.backfill_pending:
        state, d, _ = capture.backfill_step(state, d, rows, NOW)
    assert state.jobs.count() == 25 and d.backfill_scanned == 25


def test_an_empty_table_ends_its_scan(spark):
    rows = spark.createDataFrame([], "id long, name string")
    state, d = started(spark, rows, ("id",), 10)
    state, d, n = capture.backfill_step(state, d, rows, NOW)
    assert n == 0 and not d.backfill_pending and state.jobs.count() == 0


def test_a_scan_that_nobody_stops_takes_few_steps(spark, monkeypatch):
    monkeypatch.setattr(scan, "LEAST_ROWS", 50)
    rows = spark.range(3_070).select((3_070 - F.col("id")).alias("id"), F.concat(F.lit("x"), "id").alias("name"))
    seen, real = [], capture.backfill_step

    def spy(*a):
        out = real(*a)
        seen.append((out[2], out[1].backfill_cursor))
        return out

    monkeypatch.setattr(capture, "backfill_step", spy)
    state, d = started(spark, rows, ("id",), 100)
    # another has taken the first chunk
    state, d, _ = real(state, d, rows, NOW)
    state, d = capture.stepped(state, d, rows, NOW)
    assert seen == [(100, (200,)), (400, (600,)), (1600, (2200,)), (870, (3070,))] and not d.backfill_pending and d.backfill_scanned == 3_070
    assert state.jobs.where("status = 'pending'").count() == state.jobs.select("row_key").distinct().count() == 3_070
