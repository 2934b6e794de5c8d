"""Writers that die between two steps, and others that commit meanwhile."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from derivia.functions.providers import HashProvider
from derivia.operators import capture, contract, views
from derivia.plans import state as plans
from derivia.plans.catalog import Catalog
from derivia.plans.state import Conflict, State, Store, listed, published
from derivia.streaming import runtime

NOW = dt.datetime(2026, 3, 1, 8)
SIZES = ["s", "m", "l"]
READINGS = "sensor long, note string, at int"


def declared(spark):
    empty = State.empty(spark)
    catalog, d = Catalog().add_column("reading", "size", ("sensor",), ("note",), "enum", prompt="how big?", model="hash-1", schema=SIZES)
    return State(catalog, empty.jobs, empty.results, empty.spend, empty.cells), d


def fed(spark, folder, rows, schema=READINGS, **options):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    if not store.head():
        store.commit(declared(spark)[0], 0)
    changes = spark.readStream.schema(schema).parquet(f"{folder}/in")
    runtime.on_stream(changes, store, "reading", ("sensor",), HashProvider(), f"{folder}/checkpoint", lambda: NOW, **options).awaitTermination()
    return store


def test_a_file_appears_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "deep" / "name")
    assert published(spark, path, "first") and not published(spark, path, "second")
    assert open(path).read() == "first" and listed(spark, str(tmp_path / "deep")) == ["name"]


def test_a_writer_that_dies_before_the_rename_has_changed_nothing(spark, tmp_path, monkeypatch):
    store, (state, _) = Store(spark, str(tmp_path / "s")), declared(spark)
    store.commit(state, 0)

    def dies(spark_, path, text):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(f"{os.path.dirname(path)}/_draft-dead", "w").write(text[:5])
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(plans, "published", dies)
        with pytest.raises(OSError):
            store.commit(state, 1)
    assert store.head() == 1 and store.load().catalog == state.catalog
    assert store.commit(state, 1) == 2
    with pytest.raises(Conflict):
        store.commit(state, 1)


def test_a_stream_keeps_its_rows_whoever_commits_between(spark, tmp_path):
    fed(spark, tmp_path, [(1, "a", 1), (2, "b", 1)])
    store = Store(spark, f"{tmp_path}/store")
    s = store.load()
    store.commit(State(s.catalog, s.jobs, s.results, s.spend, s.cells, s.seq), store.head())  # it knows of no snapshot
    fed(spark, tmp_path, [(3, "c", 2)])
    state = store.load()
    rows = state.streams["reading"].read()
    assert sorted(r["sensor"] for r in rows.collect()) == [1, 2, 3]
    assert views.with_values(state, state.catalog.by_id(1), rows).where("size is null").count() == 0


def test_rows_of_a_lost_commit_are_never_read(spark, tmp_path):
    fed(spark, tmp_path, [(1, "a", 1)])
    store = Store(spark, f"{tmp_path}/store")
    # a writer that lost the race left its rows under the next number
    spark.createDataFrame([(9, "lost", 9)], READINGS).write.parquet(f"{store.path}/rows/reading/{store.head() + 1}")
    fed(spark, tmp_path, [(2, "b", 2)])
    assert sorted(r["sensor"] for r in store.load().streams["reading"].read().collect()) == [1, 2]


def test_deletes_in_a_stream_forget_their_rows(spark, tmp_path):
    schema = READINGS + ", removed boolean"
    fed(spark, tmp_path, [(1, "a", 1, False), (2, "b", 1, None), (3, "c", 1, False)], schema, order="at", deleted="removed")
    store = fed(spark, tmp_path, [(2, None, 2, True), (3, "c2", 3, False), (3, None, 2, True)], schema, order="at", deleted="removed")
    state = store.load()
    rows = state.streams["reading"].read()
    assert sorted((r["sensor"], r["note"]) for r in rows.collect()) == [(1, "a"), (3, "c2")]
    assert sorted(r["row_key"] for r in state.cells.collect()) == ['{"sensor":1}', '{"sensor":3}']
    assert state.jobs.where(capture.is_live()).count() == 0


def test_a_late_answer_of_a_dropped_column_is_cancelled(spark):
    from derivia import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the tables aren't here")
    assert {tuple(r)[1:] for r in queries.q_drop_column(spark, sf).collect()} == {("cancelled", 0)}


def test_lanes_and_exact_budgets_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from derivia import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the tables aren't here")
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name in ("q_lanes", "q_budgets_exact"):
        got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.ORACLE[name]).df()
        columns = sorted(want.columns)
        assert sorted(map(str, got[columns].astype(object).values.tolist())) == sorted(map(str, want[columns].astype(object).values.tolist())) or (got[columns].sort_values(columns).astype(float, errors="ignore").values == want[columns].sort_values(columns).astype(float, errors="ignore").values).all(), name


def test_two_equal_dead_jobs_give_one_live_one(spark):
    state, d = declared(spark)
    state, _ = capture.backfilled(state, d, spark.createDataFrame([(1, "a", 1)], READINGS), NOW)
    dead = state.jobs.withColumn("status", F.lit("dead"))
    twice = state.put(jobs=dead.union(dead))
    assert [r["status"] for r in contract.retried_dead(twice, d, NOW).jobs.collect()] == ["pending"]


def test_a_late_update_does_not_bring_a_deleted_row_back(spark, tmp_path):
    schema = READINGS + ", removed boolean"
    fed(spark, tmp_path, [(1, "a", 1, False), (2, "b", 1, False)], schema, order="at", deleted="removed")
    fed(spark, tmp_path, [(2, None, 5, True), (7, None, 9, True)], schema, order="at", deleted="removed")
    store = fed(spark, tmp_path, [(2, "late", 3, False), (7, "late", 8, None), (1, "c", 2, False)], schema, order="at", deleted="removed")
    kept = lambda: sorted((r["sensor"], r["note"]) for r in store.load().streams["reading"].read().collect())
    assert kept() == [(1, "c")] and sorted(r["row_key"] for r in store.load().cells.collect()) == ['{"sensor":1}']
    fed(spark, tmp_path, [(2, "back", 6, False)], schema, order="at", deleted="removed")
    assert kept() == [(1, "c"), (2, "back")]


def test_a_worker_pauses_on_a_limited_rate_and_takes_back_what_another_left(spark, tmp_path):
    from derivia.functions.providers import Answer

    rows = spark.createDataFrame([(k, f"n{k}", 1) for k in range(4)], READINGS)
    state, d = declared(spark)
    store = Store(spark, f"{tmp_path}/store")
    store.commit(state, 0)
    # one that dies after its claim
    store.transact(lambda s: contract.claim(capture.backfilled(s, d, rows, NOW)[0], {"reading": rows}, "dead", NOW, 2))
    time, slept = {"now": NOW}, []

    class Limited(HashProvider):
        def derive(self, job):
            return Answer(error="slow down", retryable=True, rate_limited=True)

    def sleep(seconds):
        slept.append(round(seconds))
        time["now"] += dt.timedelta(seconds=seconds)

    done = runtime.worker(store, lambda: {"reading": rows}, lambda now: Limited() if now < NOW + dt.timedelta(seconds=5) else HashProvider(), lambda: time["now"], sleep, poll=3600, idle_ends=True)
    # two fail and pause, wait for their retry, and the dead one's two are taken back after five minutes
    assert done == {"failed": 2, "written": 4} and slept[0] == 10 and 19 <= slept[1] <= 20 and sum(slept) >= 300
    state = store.load()
    assert {(r["status"], r["attempts"]) for r in state.jobs.collect()} == {("done", 2)} and state.cells.count() == 4
