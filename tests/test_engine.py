"""Behaviour of the derived-column engine on a three-row table, played by hand."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from derivia.functions.keys import row_key, value_error
from derivia.functions.providers import Answer, HashProvider, check_reply, classify, decided, parse_json_object, priced, question
from derivia.operators import capture, compute, contract, views
from derivia.plans.catalog import Catalog, DefinitionError
from derivia.plans.state import Conflict, State, Store
from derivia.streaming import runtime

NOW = dt.datetime(2026, 1, 15, 12)
LEVELS = ["low", "medium", "high"]


def level_provider():
    """Notes that tell a level of 5 m or more are 'high', others 'low'. The class is local, so that it goes to workers by value."""

    class LevelProvider(HashProvider):
        def derive(self, job):
            told = re.search(r"level (\d+(?:\.\d+)?) m", job["text"] or "")
            high = told is not None and float(told[1]) >= 5
            return Answer(high if job["output_type"] == "boolean" else "high" if high else "low", 0.9 if high else 0.4, "levels", {"prompt_tokens": len(job["text"] or ""), "completion_tokens": 1, "cost": 2e-5}, 30)

    return LevelProvider()


@pytest.fixture
def gauges(spark):
    return spark.createDataFrame([(1, "level 7.2 m and rising", "Elbe"), (2, "level 3.1 m", "Oder"), (3, "gauge dry", "Main")], "id long, note string, river string")


def start(spark, rows, scan=True, **options):
    options = {"output_type": "enum", "prompt": "is it an alert?", "model": "m", "schema": LEVELS} | options
    empty = State.empty(spark)
    catalog, d = Catalog().add_column("gauge", "alert", ("id",), ("note",), fields=dict(rows.dtypes), **options)
    state = State(catalog, empty.jobs, empty.results, empty.spend, empty.cells)
    return capture.backfilled(state, d, rows, NOW) if scan else (state, d)


def fill(state, rows, now=NOW, provider=None, **options):
    return runtime.run_once(state, {"gauge": rows}, provider or level_provider(), now, **options)


def jobs(state, cols="row_key, status, attempts"):
    return sorted(tuple(r) for r in state.jobs.selectExpr(*cols.split(", ")).collect())


def answer(state, claimed, value='"high"', confidence=0.9, key=None):
    rows = claimed if key is None else claimed.where(F.col("row_key") == f'{{"id":{key}}}')
    return rows.select("def_id", "row_key", "source_hash", F.lit(value).alias("value"), F.lit(confidence).cast("float").alias("confidence"), F.lit("m").alias("model"), *[F.lit(1.0).alias(c) for c in ("prompt_tokens", "completion_tokens")], F.lit(0.0001).alias("cost"), F.lit(5).alias("latency_ms"), *[F.lit(None).cast("string").alias(c) for c in ("details", "error")], F.lit(True).alias("retryable"), F.lit(False).alias("rate_limited"))


def test_declare_fill_and_read(spark, gauges):
    state, d = start(spark, gauges)
    assert [j[1:] for j in jobs(state)] == [("pending", 0)] * 3
    state, done = fill(state, gauges)
    assert done == {"written": 3}
    got = {r["id"]: r["alert"] for r in views.with_values(state, d, gauges).collect()}
    assert got == {1: "high", 2: "low", 3: "low"}
    assert fill(state, gauges)[1] == {}


def test_declarations_that_cannot_be(gauges):
    fields = dict(gauges.dtypes)
    good = {"output_type": "enum", "prompt": "p", "model": "m", "schema": LEVELS, "fields": fields}
    for bad in ({"pk": ()}, {"sources": ()}, {"sources": ("nope",)}, {"column": "note"}, {"schema": []}, {"model": ""}, {"prompt": None}, {"output_type": "vector", "schema": {"dimensions": 3}}, {"config": {"budget_usd": -1}}, {"config": {"backfill_chunk": 0}}, {"backend": "decision"}):
        args = {"table": "t", "column": "u", "pk": ("id",), "sources": ("note",)} | good | bad
        with pytest.raises(DefinitionError):
            Catalog().add_column(**args)


def test_key_check_rejects_repeats(spark):
    with pytest.raises(ValueError):
        capture.check_key(spark.createDataFrame([(1,), (1,)], "id long"), ("id",))


def test_source_edited_while_claimed_is_requeued(spark, gauges):
    state, d = start(spark, gauges)
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW)
    later = gauges.withColumn("note", F.when(F.col("id") == 1, "new text").otherwise(F.col("note")))
    state = capture.captured(state, d, gauges, later, NOW)
    state, out = contract.complete(state, answer(state, claimed), NOW)
    assert {r["row_key"]: r["outcome"] for r in out.collect()} == {'{"id":1}': "stale_requeued", '{"id":2}': "written", '{"id":3}': "written"}
    assert state.results.where("not is_current and not written").count() == 1
    assert state.spend.agg(F.sum("results")).first()[0] == 3
    assert [j for j in jobs(state) if j[1] == "pending"] == [('{"id":1}', "pending", 1)]
    # delivered again: nothing is claimed any more
    assert {r["outcome"] for r in contract.complete(state, answer(state, claimed), NOW)[1].collect()} == {"cancelled"}


def test_version_changed_while_claimed(spark, gauges):
    state, d = start(spark, gauges)
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW)
    state = contract.redefined(state, "gauge", "alert", NOW, prompt="new")
    with pytest.raises(DefinitionError):
        state.catalog.update_column("gauge", "alert", prompt="new")
    state, out = contract.complete(state, answer(state, claimed), NOW)
    assert {r["outcome"] for r in out.collect()} == {"stale_requeued"}
    state, done = fill(state, gauges)
    assert done == {"written": 3} and views.stale_rows(state).count() == 0


def test_override_pin_and_release(spark, gauges):
    for policy, expected in (("pin", "medium"), ("until_source_change", "high")):
        state, d = start(spark, gauges, config={"override_policy": policy})
        state, _ = fill(state, gauges)
        before = views.with_values(state, d, gauges)
        after = before.withColumn("alert", F.when(F.col("id") == 2, "medium").otherwise(F.col("alert")))
        state = capture.captured(state, d, before, after, NOW).materialized()
        assert views.columns(state).first()["human_overrides"] == 1
        later = after.withColumn("note", F.when(F.col("id") == 2, "level 8 m").otherwise(F.col("note")))
        state, _ = fill(capture.captured(state, d, after, later, NOW).materialized(), later)
        assert {r["id"]: r["alert"] for r in views.with_values(state, d, later).collect()}[2] == expected


def test_null_override_asks_again_and_delete_forgets(spark, gauges):
    state, d = start(spark, gauges)
    state, _ = fill(state, gauges)
    before = views.with_values(state, d, gauges)
    after = before.where("id <> 3").withColumn("alert", F.when(F.col("id") != 1, F.col("alert")))
    state = capture.captured(state, d, before, after, NOW)
    assert sorted(r[0] for r in state.results.where("is_current").select("row_key").collect()) == ['{"id":2}']
    assert [j[0] for j in jobs(state) if j[1] == "pending"] == ['{"id":1}']
    assert state.results.count() == 3


def test_hold_and_review(spark, gauges):
    state, d = start(spark, gauges, config={"low_confidence_policy": "hold"})
    state, done = fill(state, gauges)
    assert done == {"written": 1, "held": 2}
    assert views.needs_review(state).where("not written").count() == 2


def test_threshold_compares_as_float(spark, gauges):
    state, _ = start(spark, gauges)
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW)
    state, _ = contract.complete(state, answer(state, claimed, confidence=0.7), NOW)
    assert views.needs_review(state).count() == 0


def test_bad_value_is_an_error_not_a_crash(spark, gauges):
    state, _ = start(spark, gauges)
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW)
    state, out = contract.complete(state, answer(state, claimed, '"huge"'), NOW)
    assert {r["outcome"] for r in out.collect()} == {"rejected"}
    assert {j[1] for j in jobs(state)} == {"dead"}


def test_value_errors(spark):
    cases = [("enum", LEVELS, '"low"', True), ("enum", LEVELS, '"x"', False), ("integer", {}, "3.0", True), ("integer", {}, "3.5", False), ("boolean", {}, "true", True), ("boolean", {}, '"true"', False), ("numeric", {}, "1e3", True), ("numeric", {}, '"1"', False), ("vector", {"dimensions": 2}, "[1,2]", True), ("vector", {"dimensions": 2}, "[1]", False), ("enum", LEVELS, "null", True), ("text", {}, "5", False)]
    for kind, schema, value, fine in cases:
        got = spark.createDataFrame([(value,)], "v string").select(value_error(kind, schema, F.col("v"))).first()[0]
        assert (got is None) == fine, (kind, value, got)


def test_fail_backs_off_then_dies_and_retries(spark, gauges):
    class Down(HashProvider):
        def derive(self, job):
            raise TimeoutError("no answer")

    state, d = start(spark, gauges, config={"max_attempts": 2, "backoff_base_seconds": 60})
    state, done = fill(state, gauges, provider=Down())
    assert done == {"failed": 3}
    assert {r[0] for r in state.jobs.select("next_attempt_at").collect()} == {NOW + dt.timedelta(seconds=60)}
    assert fill(state, gauges)[1] == {}
    state, _ = fill(state, gauges, NOW + dt.timedelta(minutes=2), Down())
    assert {j[1:] for j in jobs(state)} == {("dead", 2)}
    state = contract.retried_dead(state, d, NOW)
    assert {j[1:] for j in jobs(state)} == {("pending", 0)}


def test_reclaim_is_strict_and_kills_at_the_last_attempt(spark, gauges):
    state, _ = start(spark, gauges, config={"max_attempts": 1})
    state, _ = contract.claim(state, {"gauge": gauges}, "w", NOW)
    assert {j[1] for j in jobs(contract.reclaimed(state, NOW + dt.timedelta(minutes=5)))} == {"claimed"}
    assert {j[1] for j in jobs(contract.reclaimed(state, NOW + dt.timedelta(minutes=6)))} == {"dead"}


def test_requeue_skips_pinned(spark, gauges):
    state, d = start(spark, gauges)
    state, _ = fill(state, gauges)
    before = views.with_values(state, d, gauges)
    after = before.withColumn("alert", F.when(F.col("id") == 2, "medium").otherwise(F.col("alert")))
    state = capture.captured(state, d, before, after, NOW).materialized()
    state = contract.requeued(state, d, gauges, NOW)
    state = contract.requeued(state, d, gauges, NOW)
    assert [j[0] for j in jobs(state) if j[1] == "pending"] == ['{"id":1}', '{"id":3}']
    state = contract.unpinned(state, d, gauges.select(row_key(("id",)).alias("row_key")), gauges, NOW)
    assert sum(j[1] == "pending" for j in jobs(state)) == 3


def test_backfill_by_chunks(spark, gauges):
    rows = gauges.union(spark.createDataFrame([(4, "d", "x"), (5, "e", "y")], gauges.schema))
    state, d = start(spark, rows, scan=False, config={"backfill_chunk": 2})
    seen = []
    while d.backfill_pending:
        state, d, _ = capture.backfill_step(state, d, rows, NOW)
        seen.append((d.backfill_scanned, state.jobs.count()))
    assert seen == [(2, 2), (4, 4), (5, 5)]


def test_budget_stops_claims(spark, gauges):
    state, _ = start(spark, gauges, config={"budget_usd": 0.0001})
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW, 1)
    state, _ = contract.complete(state, answer(state, claimed), NOW)
    assert contract.claim(state, {"gauge": gauges}, "w", NOW, 5)[1].count() == 0
    assert views.budgets(state, NOW).first()["exhausted"]
    catalog, _ = state.catalog.configure("gauge", "alert", {"budget_usd": 1})
    state = State(catalog, state.jobs, state.results, state.spend, state.cells, state.seq)
    assert contract.claim(state, {"gauge": gauges}, "w", NOW, 5)[1].count() == 2


def test_two_claimers_are_disjoint_and_gone_rows_drop_out(spark, gauges):
    state, _ = start(spark, gauges)
    state, a = contract.claim(state, {"gauge": gauges}, "a", NOW, 2)
    state, b = contract.claim(state, {"gauge": gauges.where("id < 3")}, "b", NOW, 2)
    assert [r["row_key"] for r in a.collect()] == ['{"id":1}', '{"id":2}'] or a.count() == 2
    assert b.count() == 0 and state.jobs.count() == 2


def test_disable_and_drop(spark, gauges):
    state, _ = start(spark, gauges)
    off = contract.disabled(state, "gauge", "alert")
    assert off.jobs.count() == 0 and fill(off, gauges)[1] == {}
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW)
    gone = contract.dropped(state, "gauge", "alert")
    assert {r["outcome"] for r in contract.complete(gone, answer(gone, claimed), NOW)[1].collect()} == {"cancelled"}
    again, d = gone.catalog.add_column("gauge", "alert", ("id",), ("note",), "enum", prompt="p", model="m", schema=LEVELS)
    assert d.def_id == 2


def test_decision_siblings_share_a_call(spark, gauges):
    state, _ = start(spark, gauges, scan=False, backend="decision", output_type="boolean", schema={})
    for k in range(16):
        catalog, d = state.catalog.add_column("gauge", f"c{k}", ("id",), ("note",), "boolean", backend="decision", prompt=f"q{k}", model="m", schema={})
        state = State(catalog, state.jobs, state.results, state.spend, state.cells, state.seq)
    for d in state.catalog.defs:
        state, _ = capture.backfilled(state, d, gauges, NOW)
    state = state.materialized("jobs")
    state, claimed = contract.claim(state, {"gauge": gauges}, "w", NOW, 2)
    assert claimed.count() >= 17
    calls = compute.fanned_out(claimed, list(state.catalog.defs))
    assert sorted(r[0] for r in calls.groupBy("row_key").agg(F.max(F.size("jobs"))).select("max(size(jobs))").collect())[-1] == 16


def test_embedding_batches_and_no_lineage_of_vectors(spark, gauges):
    state, d = start(spark, gauges, backend="embedding", output_type="vector", prompt=None, schema={"dimensions": 3}, backend_config={"batch_size": 2})
    state, done = fill(state, gauges, provider=HashProvider())
    assert done == {"written": 3} and state.results.where("value is not null").count() == 0
    assert views.with_values(state, d, gauges).where("size(alert) = 3").count() == 3


def test_retention_keeps_what_is_current(spark, gauges):
    state, d = start(spark, gauges, config={"lineage_retention_days": 30})
    state, _ = fill(state, gauges)
    state = contract.redefined(state, "gauge", "alert", NOW, prompt="new")
    state, _ = fill(capture.backfilled(state, state.catalog.find("gauge", "alert"), gauges, NOW)[0].materialized("jobs"), gauges)
    assert state.results.count() == 6
    later = NOW + dt.timedelta(days=31)
    assert contract.pruned(state, later).results.count() == 3
    assert contract.pruned(state, later, 2).results.count() == 4
    assert contract.pruned(state, NOW).results.count() == 6


def test_store_refuses_a_second_writer(spark, gauges, tmp_path):
    state, _ = start(spark, gauges)
    store = Store(spark, str(tmp_path / "s"))
    assert store.commit(state, 0) == 1
    with pytest.raises(Conflict):
        store.commit(state, 0)
    again = store.load()
    assert again.jobs.count() == 3 and again.catalog == state.catalog


def test_pure_helpers():
    assert parse_json_object('```json\n{"value": 1} and more') == {"value": 1}
    assert priced({"prompt_tokens": 1000, "completion_tokens": 200}, {"input_usd_per_mtok": 0.5, "output_usd_per_mtok": 2})["cost"] == pytest.approx(0.0009)
    assert priced({"cost": 1}, {"input_usd_per_mtok": 5})["cost"] == 1
    enum = {"output_type": "enum", "schema": {"a": "x", "b": "y"}, "prompt": "p"}
    assert decided(enum, {"choice": "b", "confidence": 0.8}).value == "b" and decided(enum, {"choice": "z"}).error
    assert decided({"output_type": "boolean"}, {"probability": 0.3}).confidence == pytest.approx(0.7)
    assert decided({"output_type": "integer"}, {"score": 2.5}).value == 2 and decided({"output_type": "numeric"}, {"score": 0.4}).value == 0.4
    assert question(enum)["type"] == "choice" and decided(enum, None).retryable

    class Http(Exception):
        status = 429

    assert classify(Http("slow")).rate_limited and classify(Http("slow")).retryable
    Http.status = 400
    assert not classify(Http("bad")).retryable and classify(ValueError("x")).retryable
    with pytest.raises(ValueError):
        check_reply("text", {"max_length": 2}, {"value": "abc"})
    assert isinstance(HashProvider().embed("m", ["a"], {})[0], Answer)


def streamed(spark, folder, batch, rows, **options):
    """One more file of rows through the stream of gauges kept in folder."""
    schema = "id long, note string, at int"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    if not batch:
        empty = State.empty(spark)
        catalog, _ = Catalog().add_column("gauge", "alert", ("id",), ("note",), "enum", prompt="is it an alert?", model="m", schema=LEVELS)
        store.commit(State(catalog, empty.jobs, empty.results, empty.spend, empty.cells), 0)
    changes = spark.readStream.schema(schema).parquet(f"{folder}/in")
    runtime.on_stream(changes, store, "gauge", ("id",), level_provider(), f"{folder}/checkpoint", lambda: NOW, **options).awaitTermination()
    return store


def test_stream_keeps_the_last_update_and_all_earlier_rows(spark, tmp_path):
    updates = [(1, "calm", k) for k in range(1, 20)] + [(1, "level 9 m", 20)] + [(1, "calm", 0), (2, "hello", 1)]
    store = streamed(spark, tmp_path, 0, updates, order="at")
    store.commit(store.load(), store.head())  # a commit by another makes no snapshot
    store = streamed(spark, tmp_path, 1, [(3, "thanks", 1), (1, "calm", 5)], order="at")
    rows = store.load().streams["gauge"].read()
    assert sorted(map(tuple, rows.collect())) == [(1, "level 9 m", 20), (2, "hello", 1), (3, "thanks", 1)]
    state = store.load()
    assert {r["id"]: r["alert"] for r in views.with_values(state, state.catalog.by_id(1), rows).collect()} == {1: "high", 2: "low", 3: "low"}


def test_stream_fails_on_rows_it_cannot_read(spark, tmp_path):
    store = streamed(spark, tmp_path, 0, [(1, "a", 1)])
    head = store.head()
    for part in (tmp_path / "store" / "rows" / "gauge").glob("*/part-*"):
        part.write_bytes(b"not parquet")
    for crc in (tmp_path / "store" / "rows" / "gauge").glob("*/.part-*"):
        crc.unlink()
    # a scan of all rows is asked for
    store.transact(lambda s: (contract.redefined(s, "gauge", "alert", NOW, prompt="is it one?"), None))
    with pytest.raises(Exception):
        streamed(spark, tmp_path, 1, [(2, "b", 1)])
    assert store.head() == head + 2 and store.load().jobs.where("status = 'claimed'").count() == 0


def test_stream_refuses_updates_it_cannot_order(spark, tmp_path):
    with pytest.raises(Exception, match="order column"):
        streamed(spark, tmp_path, 0, [(1, "a", 1), (1, "b", 2)])
