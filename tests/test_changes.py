"""State as a base and changes: what is written, folded, rewritten, deleted, and shared by writers."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from derivia.functions.providers import HashProvider
from derivia.operators import capture, compute, contract, views
from derivia.plans import state as plans
from derivia.plans.state import State, Store
from derivia.streaming import keyed, runtime

NOW = dt.datetime(2026, 4, 2, 9)
SIZES = ["s", "m", "l"]


def machines(spark, n):
    return spark.range(n).select(F.col("id").alias("machine"), F.concat(F.lit("runs for "), "id").alias("note"))


def queued(spark, n, **config):
    rows = machines(spark, n)
    state, d = capture.declared(State.empty(spark), rows, "machine", "size", ("machine",), ("note",), "enum", prompt="how big?", model="hash-1", schema=SIZES, config=config)
    return rows, capture.backfilled(state, d, rows, NOW)[0]


def key_of(k):
    return f'{{"machine":{k}}}'


def written_rows(monkeypatch):
    """What counted() writes: (name, rows)."""
    seen, real = [], plans.counted

    def spy(df, name, *a, **k):
        out = real(df, name, *a, **k)
        seen.append((name, out.n))
        return out

    for module in (plans, capture, contract):
        monkeypatch.setattr(module, "counted", spy)
    return seen


def test_a_claim_and_its_completion_write_as_much_as_they_change(spark, monkeypatch):
    rows, state = queued(spark, 3000)
    seen = written_rows(monkeypatch)
    for k in range(5):
        state, claimed = contract.claim(state, {"machine": rows}, "w", NOW, 40)
        state, _ = contract.complete(state, compute.computed(state, claimed, HashProvider()), NOW)
    assert all(n <= 2 * 200 for _, n in seen) and sum(n for _, n in seen) < 3000
    assert max(len(x.changes) for x in state.layers.values()) <= plans.MOST_LAYERS
    assert {r["status"]: r["count"] for r in state.jobs.groupBy("status").count().collect()} == {"pending": 2800, "done": 200}
    assert state.cells.count() == state.results.where("is_current").count() == 200
    # the first 200 in key order, each once
    assert sorted(r[0] for r in state.cells.select("row_key").collect()) == sorted(key_of(k) for k in range(200))
    assert state.spend.first()["results"] == 200


def test_many_changes_give_a_new_base(spark):
    rows, state = queued(spark, 50)
    for k in range(4):
        state = contract.redefined(state, "machine", "size", NOW, prompt=f"how big, {k}?")
        state, _ = runtime.run_once(state, {"machine": rows}, HashProvider(), NOW)
    assert state.results.count() == 200 and state.results.where("is_current").count() == 50
    assert all(x.base.n <= 0 or sum(c.n for c in x.changes) <= plans.REWRITE_AT * x.base.n for x in state.layers.values())
    assert views.stale_rows(state).count() == 0 and views.cost_by_column(state).count() == 4


def test_what_is_gone_stays_gone_through_folds(spark):
    rows, state = queued(spark, 40)
    state, _ = runtime.run_once(state, {"machine": rows}, HashProvider(), NOW)
    d = state.catalog.by_id(1)
    for k in range(8):
        state = capture.forgotten(state, d, capture.keyed(d, rows.where(F.col("machine") == k)))
    assert sorted(r[0] for r in state.cells.select("row_key").collect()) == sorted(key_of(k) for k in range(8, 40))
    assert state.results.where("is_current").count() == 32 and state.results.count() == 40


def test_an_answer_that_comes_twice_counts_once(spark):
    rows, state = queued(spark, 2)
    state, claimed = contract.claim(state, {"machine": rows}, "w", NOW)
    answers = compute.computed(state, claimed, HashProvider())
    state, out = contract.complete(state, answers.union(answers), NOW)
    assert out.count() == 2 and state.results.where("is_current").count() == state.cells.count() == state.jobs.count() == 2
    assert state.spend.agg(F.sum("results")).first()[0] == 2
    # of an error and an answer the answer counts
    state = contract.redefined(state, "machine", "size", NOW, prompt="again?")
    state, _ = capture.backfilled(state, state.catalog.by_id(1), rows, NOW)
    state, claimed = contract.claim(state, {"machine": rows}, "w", NOW)
    answers = compute.computed(state, claimed, HashProvider())
    lost = answers.withColumn("error", F.lit("lost")).withColumn("value", F.lit(None).cast("string"))
    state, out = contract.complete(state, lost.union(answers), NOW)
    assert {r["outcome"] for r in out.collect()} == {"written"} and state.results.where("is_current").count() == 2


def test_keys_are_checked_where_a_column_is_declared(spark):
    args = ("machine", "size", ("machine",), ("note",), "enum")
    options = {"prompt": "p", "model": "m", "schema": SIZES}
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="isn't a key"):
            capture.declared(State.empty(spark), spark.createDataFrame(bad, "machine long, note string"), *args, **options)
    lineitem = "/root/testdata/sf0.001/lineitem.parquet"
    if os.path.isfile(lineitem):
        with pytest.raises(ValueError, match="isn't a key"):
            capture.declared(State.empty(spark), spark.read.parquet(lineitem), "lineitem", "size", ("l_orderkey",), ("l_quantity",), "enum", **options)


def files(path):
    return {os.path.relpath(d, path) for d, _, names in os.walk(path) if any(n.startswith("part-") for n in names)}


def test_commits_share_layers_and_old_versions_go(spark, tmp_path):
    rows, state = queued(spark, 300)
    store = Store(spark, str(tmp_path / "s"), keep=3)
    store.commit(state, 0)
    base = store.manifest(1)["tables"]["jobs"]["base"]["path"]
    for _ in range(5):
        head = store.head()
        state, claimed = contract.claim(store.load(head), {"machine": rows}, "w", NOW, 10)
        state, _ = contract.complete(state, compute.computed(state, claimed, HashProvider()), NOW)
        store.commit(state, head)
    now = store.manifest(store.head())["tables"]["jobs"]
    assert now["base"]["path"] == base and len(now["changes"]) >= 2
    assert sorted(map(int, plans.listed(spark, f"{store.path}/manifests"))) == [4, 5, 6]
    named = {x["path"] for v in (4, 5, 6) for t in store.manifest(v)["tables"].values() for x in (t["base"], *t["changes"]) if x["n"]}
    assert {os.path.relpath(os.path.join(str(tmp_path / "s"), x), str(tmp_path / "s")) for x in named} <= {f.split("/status=")[0].split("/is_current=")[0] for f in files(tmp_path / "s")}
    on_disk = {f.split("/status=")[0].split("/is_current=")[0] for f in files(tmp_path / "s")}
    assert on_disk <= {x["path"] for v in (4, 5, 6) for t in store.manifest(v)["tables"].values() for x in (t["base"], *t["changes"])}
    for v in (4, 5, 6):
        assert store.load(v).jobs.where("status = 'done'").count() == 10 * (v - 1)


def test_two_claimers_get_different_jobs_and_both_commit(spark, tmp_path):
    rows, state = queued(spark, 60)
    Store(spark, str(tmp_path / "s")).commit(state, 0)
    got, gate = {}, threading.Barrier(3)

    def worker(name):
        store = Store(spark.newSession(), str(tmp_path / "s"))
        gate.wait()
        got[name] = []
        for _ in range(2):
            claimed = store.transact(lambda s: contract.claim(s, {"machine": rows}, name, NOW, 7))
            got[name] += [r["row_key"] for r in claimed.collect()]

    threads = [threading.Thread(target=worker, args=(w,)) for w in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    every = [k for keys in got.values() for k in keys]
    assert sorted(map(len, got.values())) == [14, 14, 14] and len(set(every)) == 42
    state = Store(spark, str(tmp_path / "s")).load()
    assert {(r["claimed_by"], r["row_key"]) for r in state.jobs.where("status = 'claimed'").collect()} == {(w, k) for w, keys in got.items() for k in keys}


def test_a_stream_goes_on_with_scans_of_changed_definitions(spark, tmp_path):
    schema = "machine long, note string"

    def fed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        runtime.on_stream(changes, store, "machine", ("machine",), HashProvider(), f"{tmp_path}/checkpoint", lambda: NOW).awaitTermination()

    empty = spark.createDataFrame([], schema)
    store = Store(spark, str(tmp_path / "s"))
    state, _ = capture.declared(State.empty(spark), empty, "machine", "size", ("machine",), ("note",), "enum", prompt="how big?", model="hash-1", schema=SIZES)
    store.commit(state, 0)
    fed([(k, f"n{k}") for k in range(5)])

    def change(s):
        s = contract.redefined(s, "machine", "size", NOW, prompt="how big, really?")
        return capture.declared(s, empty, "machine", "big", ("machine",), ("note",), "boolean", prompt="big?", model="hash-1", schema={})[0], None

    store.transact(change)
    fed([(9, "n9")])
    state = store.load()
    assert views.stale_rows(state).count() == 0 and state.jobs.where(capture.is_live()).count() == 0
    assert not any(d.backfill_pending for d in state.catalog.defs)
    rows = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 2, 3, 4, 9)], schema)
    fresh, _ = capture.declared(State.empty(spark), rows, "machine", "size", ("machine",), ("note",), "enum", prompt="how big, really?", model="hash-1", schema=SIZES)
    fresh, _ = capture.declared(fresh, rows, "machine", "big", ("machine",), ("note",), "boolean", prompt="big?", model="hash-1", schema={})
    fresh, _ = runtime.run_once(fresh, {"machine": rows}, HashProvider(), NOW)
    values = lambda s: sorted((r["def_id"], r["row_key"], r["value"]) for r in s.cells.collect())
    assert values(state) == values(fresh) and len(values(state)) == 12


def test_a_stream_knows_its_keys(spark, tmp_path):
    schema = "machine long, note string, at int, removed boolean"
    empty = spark.createDataFrame([], schema)
    store = Store(spark, str(tmp_path / "s"))
    state, _ = capture.declared(State.empty(spark), empty, "machine", "size", ("machine",), ("note",), "enum", prompt="how big?", model="hash-1", schema=SIZES)
    store.commit(state, 0)

    def fed(rows, place="first"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{place}/in")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/{place}/in")
        runtime.on_stream(changes, store, "machine", ("machine",), HashProvider(), f"{tmp_path}/{place}/checkpoint", lambda: NOW, order="at", deleted="removed").awaitTermination()
        return store.load()

    fed([(k, f"n{k}", 1, False) for k in range(40)])
    # a delete, a change, and one that comes again: two rows are written
    state = fed([(2, None, 3, True), (1, "new", 3, None), (0, "n0", 1, False)])
    assert [c.n for c in state.streams["machine"].layers.changes] == [2]
    # late ones change nothing, neither that of a deleted row nor with a new checkpoint
    fed([(2, "late", 2, False), (1, "late", 2, False)])
    state = fed([(1, "old", 0, False), (50, "n50", 1, False)], "second")
    rows = {r["machine"]: r["note"] for r in state.streams["machine"].read().collect()}
    assert rows == {k: f"n{k}" for k in (*range(40), 50) if k != 2} | {1: "new"}
    assert {r["row_key"] for r in state.cells.collect()} == {f'{{"machine":{k}}}' for k in rows}
    assert state.jobs.where(capture.is_live()).count() == 0 and views.stale_rows(state).count() == 0


def test_what_a_stream_knows_lies_in_the_store_with_its_rows(spark, tmp_path):
    schema = "machine long, note string, at int, removed boolean"
    store = Store(spark, str(tmp_path / "s"))
    state, _ = capture.declared(State.empty(spark), spark.createDataFrame([], schema), "machine", "size", ("machine",), ("note",), "enum", prompt="how big?", model="hash-1", schema=SIZES)
    store.commit(state, 0)

    def fed(rows, place):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{place}/in")
        changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/{place}/in")
        runtime.on_stream(changes, store, "machine", ("machine",), HashProvider(), f"{tmp_path}/{place}/checkpoint", lambda: NOW, order="at", deleted="removed").awaitTermination()

    fed([(1, "a", 1, False), (2, "b", 1, False), (None, "c", 1, False), (7, None, 4, True)], "first")
    fed([(2, None, 5, True)], "first")
    # a new stream knows the deletes, too, also that of a key that it never had
    fed([(2, "late", 4, False), (7, "late", 3, False), (None, "c", 1, False), (3, "d", 1, False)], "second")
    streamed = store.load().streams["machine"]
    assert sorted((r["machine"] or 0, r["note"]) for r in streamed.read().collect()) == [(0, "c"), (1, "a"), (3, "d")]
    entries = {r["row_key"]: (r["_order"], r["_dead"]) for r in streamed.known.read(keyed.KEY).collect()}
    assert entries == {key_of("null"): (1, False), key_of(1): (1, False), key_of(2): (5, True), key_of(3): (1, False), key_of(7): (4, True)}
    assert not os.path.exists(f"{tmp_path}/first/checkpoint/state")


def test_entries_of_keys_are_looked_up_in_all_layers_and_the_last_counts(spark, monkeypatch):
    schema = "k long, note string, at int"
    last = lambda rows: plans.counted(keyed.last_of_each(spark.createDataFrame(rows, schema), ("k",), "at"), "batch")
    known = plans.Layers(plans.Layer(keyed.learnt(last([(0, "", 0)])).rows.limit(0).drop("_gone"), 0))
    for rows in ([(1, "a", 1), (2, "a", 1)], [(1, "b", 2), (3, "a", 1)], [(1, "c", 3)]):
        known = known.with_change(keyed.KEY, keyed.learnt(last(rows)))
    assert known.changes
    batch = last([(1, "late", 2), (1, "late", 1), (2, "a", 1), (3, "b", 2), (4, "a", None)])
    found = lambda: sorted((r["row_key"], r["_known"], r["_changed"]) for r in keyed.effective(batch, known).collect())
    want = [('{"k":3}', True, ["note", "at"]), ('{"k":4}', False, ["k", "note", "at"])]
    assert found() == want
    monkeypatch.setattr(keyed, "FEW_ROWS", 0)
    assert found() == want


def test_changes_without_deletes_look_for_nothing_to_forget(spark, monkeypatch):
    rows, state = queued(spark, 3)
    monkeypatch.setattr(capture, "forgotten", lambda *a: pytest.fail("there are no deletes"))
    changes = rows.selectExpr("*", "false as _gone", "true as _known", "array('note') as _changed")
    assert capture.captured_changes(state, state.catalog.by_id(1), changes, 3, NOW).jobs.count() == 3
