"""The engine's operators as queries over the given tables, and the SQL that says the same."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.functions import keys
from derivia.functions.providers import Answer, HashProvider
from derivia.operators import capture, compute, contract, evaluate, similar, views
from derivia.plans.catalog import Catalog
from derivia.plans.state import JOBS, State, Store, conform, work_folder
from derivia.sources import changes, tables
from derivia.sources.tables import table
from derivia.streaming import runtime

NOW = dt.datetime(2026, 1, 15, 12, 0, 0)
LABELS = ["low", "medium", "high", "none"]
PROMPT = "How urgent is this?"
PROMPT_2 = "How urgent is this, really?"
#: All priorities of orders but one, which replies mustn't have.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
TEXT_ORDERS = ("o_orderkey", "o_orderpriority", "o_orderstatus")


# --- what SQL says of the hash model -----------------------------------------------------------


def h(prompt: str, text: str = "text") -> str:
    return f"sha256('{prompt}' || chr(0) || {text})"


def byte(hash_: str, i: int) -> str:
    return f"CAST('0x' || substr({hash_}, {2 * i + 1}, 2) AS INT)"


def label(hash_: str) -> str:
    return f"[{', '.join(repr(x) for x in LABELS)}][{byte(hash_, 0)} % 4 + 1]"


def confidence(hash_: str) -> str:
    return f"CAST({byte(hash_, 1)} / 255.0 AS FLOAT)"


ORDER_TEXT = "'o_orderstatus: ' || o_orderstatus || chr(10) || 'o_orderpriority: ' || o_orderpriority"


# --- states to query -----------------------------------------------------------------------------


def declared(spark: SparkSession, rows: DataFrame, name: str, pk, sources, output: str = "enum", schema=None, state: State | None = None, column: str = "derived", **options) -> tuple[State, object]:
    return capture.declared(state or State.empty(spark), rows, name, column, pk, sources, output, prompt=options.pop("prompt", PROMPT), model=options.pop("model", "hash-1"), schema=LABELS if schema is None and output == "enum" else schema, **options)


def filled(spark, rows, name, pk, sources, provider=None, **options):
    """A declared column with all rows scanned, computed and completed in one pass each."""
    state, d = declared(spark, rows, name, pk, sources, **options)
    state, d = capture.backfilled(state, d, rows, NOW)
    state, claimed = contract.claim(state, {name: rows}, "w", NOW, None)
    state, outcomes = contract.complete(state, compute.computed(state, claimed, provider or HashProvider()), NOW)
    return state, state.catalog.by_id(d.def_id), outcomes


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def on_documents(spark, sf, **options):
    return filled(spark, documents(spark, sf), "documents", ("doc_id",), ("text",), **options)


def doc_key(column: str = "row_key"):
    return F.get_json_object(column, "$.doc_id").cast("long").alias("doc_id")


def q_derive_enum(spark, sf):
    state, d, _ = on_documents(spark, sf)
    return views.with_values(state, d, documents(spark, sf)).select("doc_id", "derived")


def q_source_hash(spark, sf):
    return documents(spark, sf).select("doc_id", keys.source_hash(("text", "lang")).alias("source_hash"))


def q_composite_key(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", keys.row_key(("conv_id", "turn")).alias("row_key"), keys.source_hash(("text",)).alias("source_hash"))


def q_multi_source_text(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.sha2(keys.user_message(PROMPT, {"a": "one", "b": "two"}, keys.source_text(("source", "lang", "text"), dict(d.dtypes))), 256).alias("message_hash"))


def q_needs_review(spark, sf):
    return views.needs_review(on_documents(spark, sf)[0]).select(doc_key(), "value", F.col("confidence").cast("double").alias("confidence"), "written")


def q_held(spark, sf):
    state, d, outcomes = on_documents(spark, sf, config={"low_confidence_policy": "hold"})
    cells = views.with_values(state, d, documents(spark, sf)).select(F.col("doc_id").alias("id"), "derived")
    return outcomes.select(doc_key(), "outcome").join(cells, F.col("doc_id") == F.col("id")).select("doc_id", "outcome", "derived")


def orders_state(spark, sf, **options):
    rows = table(spark, sf, "orders")
    return rows, *filled(spark, rows, "orders", ("o_orderkey",), ("o_orderpriority", "o_orderstatus"), **options)


def order_key(column: str = "row_key"):
    return F.get_json_object(column, "$.o_orderkey").cast("long").alias("o_orderkey")


def q_stale_after_update(spark, sf):
    rows, state, d, _ = orders_state(spark, sf)
    state = contract.redefined(state, "orders", "derived", NOW, prompt=PROMPT_2)
    state, d = capture.backfilled(state, state.catalog.find("orders", "derived"), rows, NOW)
    state, claimed = contract.claim(state, {"orders": rows}, "w", NOW, 500)
    state, _ = contract.complete(state, compute.computed(state, claimed, HashProvider()), NOW)
    return views.stale_rows(state).select(order_key(), "value", "version", "current_version")


def overrides_of(rows: DataFrame) -> DataFrame:
    """The table after people set a value nobody else gives, on rows with key mod 33 = 7."""
    return rows.withColumn("derived", F.when(F.col("doc_id") % 33 == 7, F.lit("by hand")).otherwise(F.col("derived")))


def q_recompute_counts(spark, sf):
    state, d, _ = on_documents(spark, sf)
    rows = views.with_values(state, d, documents(spark, sf))
    state = capture.captured(state, d, rows, overrides_of(rows), NOW).materialized()
    state = contract.redefined(state, "documents", "derived", NOW, prompt=PROMPT_2)
    state, _ = capture.backfilled(state, state.catalog.find("documents", "derived"), rows, NOW)
    return views.columns(state).select("version", "pending", "done", "human_overrides", "stale")


def edited(rows: DataFrame) -> DataFrame:
    """The next snapshot: some texts edited, some rows gone, 20 new ones."""
    new = rows.orderBy("doc_id").limit(20).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    return rows.where("doc_id % 17 <> 5").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).union(new)


EDITED = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 5 UNION ALL SELECT doc_id + 10000000, text FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 20)"


def q_diff_enqueue(spark, sf):
    state, d, _ = on_documents(spark, sf)
    state = capture.captured(state, d, documents(spark, sf), edited(documents(spark, sf)), NOW)
    live = state.jobs.where("status = 'pending'").select(doc_key(), F.lit("pending").alias("what"))
    gone = state.results.where("not is_current").select(doc_key(), F.lit("forgotten").alias("what"))
    return live.union(gone)


def override_then_edit(spark, sf, policy: str):
    state, d, _ = on_documents(spark, sf, config={"override_policy": policy})
    before = views.with_values(state, d, documents(spark, sf))
    after = overrides_of(before)
    state = capture.captured(state, d, before, after, NOW).materialized()
    later = after.withColumn("text", F.concat("text", F.lit(" edited")))
    state = capture.captured(state, d, after, later, NOW)
    state, _ = runtime.run_once(state.materialized(), {"documents": later}, HashProvider(), NOW)
    return views.with_values(state, d, later).select("doc_id", "derived")


def q_override_pin(spark, sf):
    return override_then_edit(spark, sf, "pin")


def q_override_release(spark, sf):
    return override_then_edit(spark, sf, "until_source_change")


def q_unpin(spark, sf):
    state, d, _ = on_documents(spark, sf)
    before = views.with_values(state, d, documents(spark, sf))
    state = capture.captured(state, d, before, overrides_of(before), NOW).materialized()
    state = contract.unpinned(state, d, before.where("doc_id % 2 = 1").select(keys.row_key(("doc_id",)).alias("row_key")), before, NOW)
    return state.jobs.where("status = 'pending'").select(doc_key(), "source_hash")


def q_requeue(spark, sf):
    state, d, _ = on_documents(spark, sf)
    before = views.with_values(state, d, documents(spark, sf))
    state = capture.captured(state, d, before, overrides_of(before), NOW).materialized()
    state = contract.requeued(state, d, before.where("lang = 'de'"), NOW)
    return state.jobs.where("status = 'pending'").select(doc_key(), "attempts")


def three_columns(spark, sf):
    """An enum, a boolean and a priced enum of the same table, the last one failing now and then."""
    rows = documents(spark, sf)
    state, _, _ = on_documents(spark, sf)
    state, b = declared(spark, rows, "documents", ("doc_id",), ("text",), "boolean", {}, state, "flag", prompt="Is it?")
    state, c = declared(spark, rows, "documents", ("doc_id",), ("text",), "enum", None, state, "shaky", prompt="Which?", config={"budget_usd": 0.001, "max_attempts": 1})
    state, _ = capture.backfilled_all(state, [b, c], rows, NOW)
    state, claimed = contract.claim(state, {"documents": rows}, "w", NOW, None)
    return contract.complete(state, compute.computed(state, claimed, HashProvider(fail_below=8)), NOW)[0]


def q_columns_view(spark, sf):
    return views.columns(three_columns(spark, sf)).select("column_name", "version", "pending", "claimed", "done", "dead", "human_overrides", "stale")


def q_dead_jobs(spark, sf):
    return views.dead_jobs(three_columns(spark, sf)).select("column_name", doc_key(), "attempts", "last_error")


def q_cost_by_column(spark, sf):
    return views.cost_by_column(three_columns(spark, sf)).select("column_name", "version", "model", "results", "prompt_tokens", "completion_tokens", F.round("cost_usd", 6).alias("cost_usd"), "avg_latency_ms")


def q_budgets(spark, sf):
    b = views.budgets(three_columns(spark, sf), NOW)
    return b.select("def_id", "budget_usd", F.round("spent", 6).alias("spent"), F.round("remaining", 6).alias("remaining"), "exhausted")


def q_budgets_exact(spark, sf):
    """What is spent in whole decimals, before any rounding."""
    use = contract.budget_use(three_columns(spark, sf), NOW).where("not deleted")
    return use.select("def_id", F.col("spent").cast("decimal(38,12)").alias("spent"), F.coalesce(F.col("spent") >= F.col("budget_usd").cast("decimal(38,12)"), F.lit(False)).alias("exhausted"))


def spend_of_events(spark, sf):
    """A cost of (user_id mod 7 + 1) / 1000 USD for each event, on days before NOW."""
    e = table(spark, sf, "events")
    day = F.date_sub(F.lit(NOW.date()), F.pmod(F.col("event_id"), F.lit(40)).cast("int"))
    e = e.select(F.lit(1).cast("long").alias("def_id"), day.alias("day"), ((F.col("user_id") % 7 + 1) / 1000).cast("decimal(38,12)").alias("cost"))
    return e.groupBy("def_id", "day").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("results"))


def q_spent_month(spark, sf):
    state = State.empty(spark).put(spend=spend_of_events(spark, sf))
    parts = [contract.spent(state, 1, p, NOW).select(F.lit(p).alias("period"), F.round(F.col("spent").cast("double"), 6).alias("spent")) for p in ("day", "month", "total")]
    return parts[0].union(parts[1]).union(parts[2])


def q_backfill_keyset(spark, sf):
    rows = table(spark, sf, "orders")
    state, d = declared(spark, rows, "orders", ("o_orderkey",), ("o_orderpriority",), config={"backfill_chunk": 700})
    for _ in range(3):
        state, d, _ = capture.backfill_step(state, d, rows, NOW)
        state = state.materialized("jobs")
    return state.jobs.select(order_key(), "status")


def q_backfill_all(spark, sf):
    """The chunked scan carried to its end: every order is queued."""
    rows = table(spark, sf, "orders")
    state, d = declared(spark, rows, "orders", ("o_orderkey",), ("o_orderpriority",), config={"backfill_chunk": 100_000})
    state, _ = capture.stepped(state, d, rows, NOW)
    return state.jobs.select(order_key(), "status")


def jobs_of_events(spark, sf) -> DataFrame:
    """A job for each event: pending, claimed or dead by type, attempts and times read off the ids."""
    e = table(spark, sf, "events")
    at = F.lit(NOW) + F.make_dt_interval(secs=(F.pmod(F.col("user_id") * 31, F.lit(1000)) - 700).cast("decimal(18,6)"))
    status = F.when(F.col("event_type") == "error", "dead").when(F.col("event_id") % 3 == 0, "claimed").otherwise("pending")
    e = e.select(F.lit(1).alias("def_id"), F.to_json(F.struct("event_id")).alias("row_key"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("row_order"), F.lit("x").alias("source_hash"), status.alias("status"), (F.col("event_id") % 6).cast("int").alias("attempts"), at.alias("next_attempt_at"), at.alias("claimed_at"), F.lit(1).alias("claimed_version"), F.when(F.col("event_type") == "error", "boom").alias("last_error"), F.lit(0).alias("seq"), F.lit(NOW).alias("updated_at"))
    return conform(e, JOBS)


def with_jobs(spark, sf, **config):
    catalog, d = Catalog().add_column("events", "derived", ("event_id",), ("value",), "enum", prompt=PROMPT, model="hash-1", schema=LABELS, config=config)
    s = State.empty(spark)
    return State(catalog, jobs_of_events(spark, sf), s.results, s.spend, s.cells), d


def event_key():
    return F.get_json_object("row_key", "$.event_id").cast("long").alias("event_id")


def seconds(c: str):
    return (F.col(c).cast("double") - F.lit(NOW).cast("double")).cast("long").alias("wait_s")


JOBS_SQL = "SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' WHEN event_id % 3 = 0 THEN 'claimed' ELSE 'pending' END AS status, CAST(event_id % 6 AS INT) AS attempts, (user_id * 31) % 1000 - 700 AS wait_s FROM events"


def q_claim_topk(spark, sf):
    state, _ = with_jobs(spark, sf)
    return contract.picked(state, NOW, {1}, 250).select(event_key())


def q_backoff(spark, sf):
    state, _ = with_jobs(spark, sf, backoff_base_seconds=30, max_attempts=5)
    errors = state.jobs.where("status = 'claimed'").select("def_id", "row_key", F.lit("timeout").alias("error"), (event_key() % 7 != 0).alias("retryable"))
    out = contract.failed(state, errors, NOW).jobs.where("last_error = 'timeout'")
    return out.select(event_key(), "status", "attempts", seconds("next_attempt_at"))


def q_reclaim(spark, sf):
    state, _ = with_jobs(spark, sf, max_attempts=4)
    return contract.reclaimed(state, NOW).jobs.where("last_error like 'reclaimed%'").select(event_key(), "status", "attempts")


def q_retry_dead(spark, sf):
    state, d = with_jobs(spark, sf)
    live = state.jobs.where("status = 'dead' and attempts = 2").withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(9))
    state = state.put(jobs=state.jobs.union(live))
    out = contract.retried_dead(state, d, NOW).jobs
    return out.where("last_error = 'boom'").select(event_key(), "status", "attempts")


def q_next_ready(spark, sf):
    state, _ = with_jobs(spark, sf)
    waiting = state.jobs.where(F.col("next_attempt_at") > F.lit(NOW))
    return evaluate.next_ready(waiting, NOW).select(F.col("seconds").cast("long").alias("seconds"))


def q_progress(spark, sf):
    return evaluate.progress(views.columns(three_columns(spark, sf))).select(*[F.col(c).cast("long").alias(c) for c in ("pending", "claimed", "done", "dead")])


def q_top_errors(spark, sf):
    state, _ = with_jobs(spark, sf)
    return evaluate.top_errors(state.jobs)


def decision_state(spark, sf, n: int = 19):
    rows = documents(spark, sf)
    state = State.empty(spark)
    for k in range(n):
        state, _ = declared(spark, rows, "documents", ("doc_id",), ("text",), "boolean", {}, state, f"flag_{k}", prompt=f"Is it {k}?", backend="decision")
    state, _ = capture.backfilled_all(state, list(state.catalog.defs), rows, NOW)
    return contract.claim(state, {"documents": rows}, "w", NOW, None)


def q_decision_fanout(spark, sf):
    state, claimed = decision_state(spark, sf)
    calls = compute.fanned_out(claimed, list(state.catalog.defs))
    return calls.select(doc_key(), F.col("call").cast("long").alias("call"), F.size("jobs").cast("long").alias("questions"))


def q_lanes(spark, sf):
    """Three backends at the same time over one table: what each lane has written."""
    rows = documents(spark, sf)
    state, d = declared(spark, rows, "documents", ("doc_id",), ("text",))
    state, _ = capture.backfilled(state, d, rows, NOW)
    state, d = declared(spark, rows, "documents", ("doc_id",), ("text",), "vector", {"dimensions": 3}, state, "place", backend="embedding", prompt=None)
    state, _ = capture.backfilled(state, d, rows, NOW)
    state, d = declared(spark, rows, "documents", ("doc_id",), ("text",), "boolean", {}, state, "flag", backend="decision", prompt="Is it?")
    state, _ = capture.backfilled(state, d, rows, NOW)
    state, done = runtime.lanes(state.materialized("jobs"), {"documents": rows}, LengthEmbedder(), NOW)
    lane = spark.createDataFrame([(k, v.get("written", 0)) for k, v in done.items()], "backend string, written long")
    cells = state.cells.groupBy("def_id").agg(F.count(F.lit(1)).alias("cells")).join(state.defs().select("def_id", "backend"), "def_id")
    return lane.join(cells, "backend").select("backend", "written", "cells")


def q_drop_column(spark, sf):
    """A column dropped while its jobs are claimed: late answers are cancelled, and nothing of it is live or stored."""
    rows = documents(spark, sf)
    state, d = declared(spark, rows, "documents", ("doc_id",), ("text",))
    state, _ = capture.backfilled(state, d, rows, NOW)
    state, claimed = contract.claim(state.materialized("jobs"), {"documents": rows}, "w", NOW, None)
    answers = compute.computed(state, claimed, HashProvider())
    state, outcomes = contract.complete(contract.dropped(state, "documents", "derived", drop_target=True), answers, NOW)
    left = state.jobs.where(capture.is_live()).count() + state.cells.count()
    return outcomes.select(doc_key(), "outcome", F.lit(left).alias("left_over"))


def q_questions_per_call(spark, sf):
    state, claimed = decision_state(spark, sf, 3)
    state, _ = contract.complete(state, compute.computed(state, claimed, HashProvider()), NOW)
    r = state.results
    return evaluate.run_metrics(r, state.jobs).select("def_id", "results", F.round("questions_per_call", 2).alias("questions_per_call"), F.col("retries").cast("long").alias("retries"))


class LengthEmbedder(HashProvider):
    """Vectors of three numbers that SQL can tell."""

    def embed(self, model, texts, config) -> list[Answer]:
        return [Answer([float(len(t)), float(t.count(" ")), 1.0], None, model, {"prompt_tokens": 3.0}, 1) for t in texts]


def q_embed_batches(spark, sf):
    rows = documents(spark, sf)
    state, d, _ = filled(spark, rows, "documents", ("doc_id",), ("text",), LengthEmbedder(), output="vector", schema={"dimensions": 3}, backend="embedding", prompt=None, backend_config={"batch_size": 64})
    v = views.with_values(state, d, rows)
    kept = state.results.agg(F.count("value").alias("stored")).first()["stored"]
    return v.select("doc_id", F.col("derived")[0].cast("long").alias("chars"), F.col("derived")[1].cast("long").alias("blanks"), F.lit(kept).alias("stored_values"))


def q_similar_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()["embedding"]
    return evaluate.nearest(e, "vec_id", "embedding", first, 20).select("vec_id", F.round("distance", 4).alias("distance"))


def q_similar_index(spark, sf):
    """The 20 rows nearest to every hundredth row, through the index; an approximation, so no SQL, and held against brute force by a test."""
    e = table(spark, sf, "embeddings")
    size = e.where("embedding is not null").select(F.size("embedding").alias("n")).head()
    index = similar.indexed(e, "vec_id", "embedding", size["n"] if size else 1)
    asks = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return similar.nearest(index, asks, "query_id", "embedding", 20)


def predictions(spark, sf) -> DataFrame:
    """pred, other, gold, confidence: two models' booleans against the quality label."""
    rows = documents(spark, sf)
    state, d, _ = filled(spark, rows, "documents", ("doc_id",), ("text",), output="boolean", schema={})
    got = state.results.where("is_current").select(doc_key(), F.col("value").alias("value"), "confidence")
    other = F.conv(F.substring(F.sha2(F.col("text"), 256), 1, 2), 16, 10).cast("int") % 3 > 0
    gold = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    return got.join(rows.select("doc_id", other.alias("b")), "doc_id").join(gold, "doc_id").select("doc_id", (F.col("value") == "true").alias("pred"), (F.col("value") == "true").alias("a"), "b", "gold", "confidence")


PRED_SQL = f"SELECT d.doc_id, {byte(h(PROMPT), 0)} % 2 = 0 AS pred, {byte('sha256(text)', 0)} % 3 > 0 AS b, quality = 1 AS gold, {confidence(h(PROMPT))} AS confidence FROM documents d JOIN labels l USING (doc_id)"


def q_accuracy(spark, sf):
    return evaluate.accuracy(predictions(spark, sf))


def q_agreement(spark, sf):
    return evaluate.agreement(predictions(spark, sf)).select("n", "agreement", "accuracy_when_agree", F.col("disagreements").cast("long").alias("disagreements"))


def q_calibration(spark, sf):
    return evaluate.calibration(predictions(spark, sf))


def q_per_class(spark, sf):
    return evaluate.per_class(predictions(spark, sf))


def q_confusions(spark, sf):
    return evaluate.confusions(predictions(spark, sf))


def q_multi_accuracy(spark, sf):
    p = predictions(spark, sf)
    return evaluate.multi_accuracy(p.select(F.col("pred"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array("gold")).alias("gold")))


def q_stratified_sample(spark, sf):
    return evaluate.stratified(documents(spark, sf), "lang", "doc_id", 25).select("doc_id", "lang")


def q_prune(spark, sf):
    state, d, _ = on_documents(spark, sf, config={"lineage_retention_days": 30})
    aged = F.lit(NOW) - F.make_dt_interval(days=F.pmod(doc_key(), F.lit(90)).cast("int"))
    results = state.results.withColumn("created_at", aged).withColumn("is_current", doc_key() % 5 == 0)
    jobs = state.jobs.withColumn("updated_at", aged)
    state = contract.pruned(state.put(results=results, jobs=jobs), NOW, None)
    return state.results.select(F.lit("result").alias("kept"), doc_key()).union(state.jobs.select(F.lit("job").alias("kept"), doc_key()))


def q_json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


class TitleProvider(HashProvider):
    """A custom backend: user code that finds a page's title."""

    def derive(self, job: dict) -> Answer:
        text = job["text"] or ""
        a = text.find("<title>")
        b = text.find("</title>", a)
        return Answer(text[a + 7 : b] if a >= 0 and b >= 0 else "", None, "title-1", {})


def q_html_title(spark, sf):
    rows = table(spark, sf, "pages")
    state, d, _ = filled(spark, rows, "pages", ("page_id",), ("html",), TitleProvider(), output="text", schema={}, backend="custom", model="title-1")
    return views.with_values(state, d, rows).select("page_id", F.col("derived").alias("title"))


def q_failure_audit(spark, sf):
    """Failures, retries and an edited table: what is wrong in the end, against the closed form."""
    rows = documents(spark, sf)
    state, d = declared(spark, rows, "documents", ("doc_id",), ("text",), config={"max_attempts": 50, "backoff_base_seconds": 0})
    state, d = capture.backfilled(state, d, rows, NOW)
    state, claimed = contract.claim(state.materialized("jobs"), {"documents": rows}, "w", NOW, None)
    answers = compute.computed(state, claimed, HashProvider(fail_below=8))
    later = edited(rows)
    state = capture.captured(state, state.catalog.by_id(1), rows, later, NOW).materialized()
    state, _ = contract.complete(state, answers, NOW)
    state, _ = contract.complete(state, answers, NOW)  # delivered twice
    state, _ = runtime.drain(state, {"documents": later}, HashProvider(), NOW)
    word = lambda t: F.element_at(F.array(*map(F.lit, LABELS)), F.conv(F.substring(F.sha2(F.concat(F.lit(PROMPT + "\0"), t), 256), 1, 2), 16, 10).cast("int") % 4 + 1)
    expected = later.select(keys.row_key(("doc_id",)).alias("row_key"), keys.as_json("enum", word(F.col("text"))).alias("value"), F.lit(None).cast("string").alias("old_text_value"), F.lit(None).cast("string").alias("old_prompt_value"), F.lit(False).alias("human"))
    return evaluate.failure_audit(state.cells.where("def_id = 1"), expected).select(*[F.col(c).cast("long").alias(c) for c in ("missing", "wrong", "wrong_old_text", "wrong_old_prompt", "fixes_overwritten")])


class ChatProvider:
    """A chat model that replies as text, right or wrong in ways that the text of the row tells: what it is asked is in the message."""

    def reply(self, job: dict) -> Answer:
        key, priority = (line.split(": ", 1)[1] for line in job["message"].rsplit("Data:\n", 1)[1].split("\n"))
        good = f'{{"value": "{priority}", "confidence": 0.5}}'
        kinds = [
            good, f"```json\n{good}\n```\nThat is all.", f'{{"value": "{priority}"}}', f'{{"value": "{priority}", "confidence": 0.5, "why": 1}}', f'{{"value": "{priority}", "confidence": {key}}}',
            '{"value": 7, "confidence": 0.5}', f"I think {priority}", f'["{priority}", 0.5]', '{"value": null, "confidence": 0.5}',
        ]
        return Answer(kinds[int(key) % 9], model="chat-1", usage={"prompt_tokens": 5, "completion_tokens": 5, "cost": 0.25})


def q_replies(spark, sf):
    """Replies of every kind over orders, through the message, the reply's schema and its check: what is current, and why the others failed."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    rows = rows.withColumn("priority_text", F.col("o_orderpriority")).withColumn("key_", F.col("o_orderkey"))
    state, d = declared(spark, rows, "orders", ("o_orderkey",), ("priority_text", "key_"), schema={x: x.lower() for x in PRIORITIES}, config={"max_attempts": 1})
    state, d = capture.backfilled(state, d, rows, NOW)
    state, _ = runtime.run_once(state, {"orders": rows}, ChatProvider(), NOW)
    key = lambda: F.get_json_object("row_key", "$.o_orderkey").cast("long").alias("o_orderkey")
    fine = state.results.where("is_current").select(key(), keys.typed_value("enum", F.col("value")).alias("value"), F.col("confidence").cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"))
    return fine.union(state.jobs.where("status = 'dead'").select(key(), F.lit(None).cast("string"), F.lit(None).cast("double"), "last_error"))


def streamed_events(spark, sf, files: int):
    """Events in some files, a store that has no column yet, and what runs the stream over the files so far."""
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    rows.repartition(files, "event_id").write.parquet(f"{base}/all")
    store = Store(spark, f"{base}/store")
    store.commit(State.empty(spark), 0)
    whole = spark.read.schema(rows.schema).parquet(f"{base}/all")

    def run(part: DataFrame):
        part.write.mode("append").parquet(f"{base}/in")
        changes = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        runtime.on_stream(changes, store, "events", ("event_id",), HashProvider(), f"{base}/checkpoint", lambda: NOW).awaitTermination()

    return whole, store, run


def event_column(state, column: str, prompt: str, output: str = "enum", schema=LABELS):
    catalog, _ = state.catalog.add_column("events", column, ("event_id",), ("event_type",), output, prompt=prompt, model="hash-1", schema=schema)
    return replace(state, catalog=catalog), None


def q_stream_equals_batch(spark, sf):
    """Events as a stream in micro-batches, kept by the engine; the column that comes out."""
    rows, store, run = streamed_events(spark, sf, 3)
    store.transact(lambda s: event_column(s, "derived", PROMPT))
    run(rows)
    state = store.load()
    return views.with_values(state, state.catalog.by_id(1), rows).select("event_id", "derived")


def q_stream_redefined(spark, sf):
    """Between two micro-batches a column is redefined and another declared: rows of before get both, too."""
    rows, store, run = streamed_events(spark, sf, 2)
    store.transact(lambda s: event_column(s, "derived", PROMPT))
    run(rows.where("event_id % 2 = 0"))
    store.transact(lambda s: event_column(contract.redefined(s, "events", "derived", NOW, prompt=PROMPT_2), "flag", "Is it?", "boolean", {}))
    run(rows.where("event_id % 2 = 1"))
    state = store.load()
    both = views.with_values(state, state.catalog.by_id(2), views.with_values(state, state.catalog.by_id(1), rows))
    return both.select("event_id", "derived", "flag", F.lit(views.stale_rows(state).count()).alias("stale"))


def q_timers(spark, sf):
    """A model that is out for two minutes: what failed comes back by its timers alone, under a clock that only sleeping moves."""
    rows = documents(spark, sf)
    store = Store(spark, f"{work_folder(spark)}/timers-{uuid.uuid4().hex}")
    state, _ = declared(spark, rows, "documents", ("doc_id",), ("text",))
    store.commit(state, 0)
    time = {"now": NOW}
    sleep = lambda s: time.update(now=time["now"] + dt.timedelta(seconds=s))
    runtime.worker(store, lambda: {"documents": rows}, lambda now: HashProvider(fail_below=8 if now < NOW + dt.timedelta(minutes=2) else 0), lambda: time["now"], sleep, poll=1000, idle_ends=True)
    state = store.load()
    values = views.with_values(state, state.catalog.by_id(1), rows).select("doc_id", "derived")
    return values.join(state.jobs.select(doc_key(), "attempts", "status"), "doc_id")


def q_disable_enable(spark, sf):
    """A column switched off while half of its jobs are claimed, and on again: the first chunk of the new scan."""
    rows = table(spark, sf, "orders")
    state, d = declared(spark, rows, "orders", ("o_orderkey",), TEXT_ORDERS[1:], config={"backfill_chunk": 300})
    state, d, _ = capture.backfill_step(state, d, rows, NOW)
    state, _ = contract.claim(state, {"orders": rows}, "w", NOW, 150)
    state = contract.disabled(state, "orders", "derived")
    left = state.jobs.select(F.lit("off").alias("when"), order_key(), "status")
    state, n = contract.enabled(state, "orders", "derived", rows, NOW)
    return left.union(state.jobs.select(F.lit("on").alias("when"), order_key(), "status")).withColumn("waiting", F.lit(n))


def q_retry_dead_rows(spark, sf):
    state, d = with_jobs(spark, sf)
    keys_ = state.jobs.where(event_key() % 5 == 0).select("row_key")
    return contract.retried_dead(state, d, NOW, keys_).jobs.where("last_error = 'boom'").select(event_key(), "status", "attempts")


def q_decision_siblings(spark, sf):
    """A claim of ten decision jobs of one column takes their rows' other questions to the same model along, not those to another."""
    rows, state = documents(spark, sf), State.empty(spark)
    for name, model in (("one", "hash-1"), ("two", "hash-1"), ("three", "hash-2")):
        state, _ = declared(spark, rows, "documents", ("doc_id",), ("text",), "boolean", {}, state, name, prompt=name, model=model, backend="decision")
        state, _ = capture.backfilled(state, state.catalog.find("documents", name), rows, NOW)
    _, claimed = contract.claim(state, {"documents": rows}, "w", NOW, 10)
    return claimed.select("def_id", doc_key())


def q_forget_missing(spark, sf):
    """Rows that went unseen, and then all of them: what is current after each."""
    state, d, _ = on_documents(spark, sf)
    state = capture.forgotten_missing(state, d, documents(spark, sf).where("doc_id % 3 <> 1"))
    some = state.results.where("is_current").select(F.lit("some").alias("when"), doc_key())
    rows = documents(spark, sf)
    state = capture.captured(state, d, rows.where("doc_id % 3 <> 1"), rows.limit(0), NOW)
    return some.union(state.results.where("is_current").select(F.lit("none").alias("when"), doc_key())).union(state.results.where("not is_current").select(F.lit("history").alias("when"), doc_key()))


def q_prune_bounded(spark, sf):
    """The 100 oldest of each that may go, and then every old job."""
    state, d, _ = on_documents(spark, sf, config={"lineage_retention_days": 30})
    aged = F.lit(NOW) - F.make_dt_interval(days=F.pmod(doc_key(), F.lit(90)).cast("int"))
    state = state.put(results=state.results.withColumn("created_at", aged).withColumn("is_current", doc_key() % 5 == 0), jobs=state.jobs.withColumn("updated_at", aged))
    bounded = contract.pruned(state, NOW, 100)
    whole = contract.pruned_jobs(bounded, NOW)
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return n("results", bounded.results).union(n("jobs", bounded.jobs)).union(n("jobs after all", whole.jobs))


def q_sources(spark, sf):
    """Documents through every kind of file that the engine reads and writes."""
    rows, base = documents(spark, sf), f"{work_folder(spark)}/sources-{uuid.uuid4().hex}"
    out = []
    for kind, options in (("parquet", {}), ("orc", {}), ("json", {"compression": "gzip"}), ("csv", {"escape": '"', "multiLine": "true"})):
        tables.write(rows, f"{base}/{kind}", kind, by=("lang",), **options)
        back = tables.read(spark, f"{base}/{kind}", kind, "doc_id long, text string, source string, lang string", **options)
        out.append(back.select(F.lit(kind).alias("kind"), "doc_id", "lang", F.sha2("text", 256).alias("text_hash")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def q_change_source(spark, sf):
    """Events as signed changes in compressed files, streamed in two runs of one checkpoint: all, then deletes of every seventh, then half of these back."""
    spark.dataSource.register(changes.ChangeSource)
    base = f"{work_folder(spark)}/changes-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select(F.lit("+").alias("op"), "event_id", "event_type")

    def put(folder, df):
        tables.write(df, f"{base}/in/{folder}", "json", compression="gzip")

    def run():
        stream = spark.readStream.format("changes").schema("op string, event_id long, event_type string, _file string, _line long").option("path", f"{base}/in").load()
        keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    put("000", rows)
    put("001", rows.where("event_id % 7 = 0").select(F.lit("-").alias("op"), "event_id"))
    run()
    put("002", rows.where("event_id % 14 = 0").withColumn("event_type", F.concat("event_type", F.lit(" again"))))
    run()
    return changes.latest(spark.read.parquet(f"{base}/rows").drop("batch"), "event_id")


def q_failure_audit_naive(spark, sf):
    """The audit of a process without state: it misses rows, keeps values of old texts and old prompts, and writes over people's values."""
    rows = documents(spark, sf)
    word = lambda prompt, text: keys.as_json("enum", F.element_at(F.array(*map(F.lit, LABELS)), F.conv(F.substring(F.sha2(F.concat(F.lit(prompt + "\0"), text), 256), 1, 2), 16, 10).cast("int") % 4 + 1))
    new = F.concat("text", F.lit(" edited"))
    human = F.col("doc_id") % 33 == 7
    text = F.when(F.col("doc_id") % 10 == 3, F.col("text")).otherwise(new)
    had = rows.where("doc_id % 17 <> 5").select(keys.row_key(("doc_id",)).alias("row_key"), F.when(F.col("doc_id") % 7 == 2, word(PROMPT, text)).otherwise(word(PROMPT_2, text)).alias("value"))
    expected = rows.select(keys.row_key(("doc_id",)).alias("row_key"), F.when(human, F.lit('"by hand"')).otherwise(word(PROMPT_2, new)).alias("value"), word(PROMPT_2, F.col("text")).alias("old_text_value"), word(PROMPT, new).alias("old_prompt_value"), human.alias("human"))
    return evaluate.failure_audit(had, expected).select(*[F.col(c).cast("long").alias(c) for c in ("missing", "wrong", "wrong_old_text", "wrong_old_prompt", "fixes_overwritten")])


FILLED = "(SELECT count(*) FROM documents)"
BOTH = f"""(SELECT 'flag' AS c, {h("Is it?")} AS h, text FROM documents UNION ALL SELECT 'shaky', {h("Which?")}, text FROM documents)"""
COST = "CAST((length(text) // 4 + 10) * 0.5 / 1e6 + 16 / 1e6 AS DECIMAL(38,12))"

ORACLE = {
    "q_derive_enum": f"SELECT doc_id, {label(h(PROMPT))} AS derived FROM documents",
    "q_source_hash": "SELECT doc_id, sha256(to_json({lang: lang, text: text})) AS source_hash FROM documents",
    "q_composite_key": "SELECT conv_id, turn, CAST(to_json({turn: turn, conv_id: conv_id}) AS VARCHAR) AS row_key, sha256(to_json({text: text})) AS source_hash FROM conversations",
    "q_multi_source_text": f"SELECT doc_id, sha256('{PROMPT}' || chr(10) || chr(10) || 'Options:' || chr(10) || '- a: one' || chr(10) || '- b: two' || chr(10) || chr(10) || 'Data:' || chr(10) || 'lang: ' || lang || chr(10) || 'text: ' || text || chr(10) || 'source: ' || source) AS message_hash FROM documents",
    "q_needs_review": f"""SELECT doc_id, '"' || {label(h(PROMPT))} || '"' AS value, CAST({confidence(h(PROMPT))} AS DOUBLE) AS confidence, true AS written FROM documents WHERE {confidence(h(PROMPT))} < CAST(0.7 AS FLOAT)""",
    "q_held": f"SELECT doc_id, CASE WHEN {confidence(h(PROMPT))} < CAST(0.7 AS FLOAT) THEN 'held' ELSE 'written' END AS outcome, CASE WHEN {confidence(h(PROMPT))} >= CAST(0.7 AS FLOAT) THEN {label(h(PROMPT))} END AS derived FROM documents",
    "q_stale_after_update": f"""SELECT o_orderkey, '"' || {label(h(PROMPT, ORDER_TEXT))} || '"' AS value, 1 AS version, 2 AS current_version FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500)""",
    "q_recompute_counts": f"SELECT 2 AS version, count(*) FILTER (WHERE doc_id % 33 <> 7) AS pending, count(*) AS done, count(*) FILTER (WHERE doc_id % 33 = 7) AS human_overrides, count(*) FILTER (WHERE doc_id % 33 <> 7) AS stale FROM documents WHERE {FILLED} > 0",
    "q_diff_enqueue": f"SELECT n.doc_id, 'pending' AS what FROM ({EDITED}) n LEFT JOIN documents o USING (doc_id) WHERE o.doc_id IS NULL OR o.text <> n.text UNION ALL SELECT doc_id, 'forgotten' FROM documents WHERE doc_id % 17 = 5",
    "q_override_pin": f"SELECT doc_id, CASE WHEN doc_id % 33 = 7 THEN 'by hand' ELSE {label(h(PROMPT, 'text || chr(32) || chr(101) || chr(100) || chr(105) || chr(116) || chr(101) || chr(100)'))} END AS derived FROM documents",
    "q_override_release": f"SELECT doc_id, {label(h(PROMPT, 'text || chr(32) || chr(101) || chr(100) || chr(105) || chr(116) || chr(101) || chr(100)'))} AS derived FROM documents",
    "q_unpin": "SELECT doc_id, sha256(to_json({text: text})) AS source_hash FROM documents WHERE doc_id % 33 = 7 AND doc_id % 2 = 1",
    "q_requeue": "SELECT doc_id, 0 AS attempts FROM documents WHERE lang = 'de' AND doc_id % 33 <> 7",
    "q_columns_view": f"SELECT 'derived' AS column_name, 1 AS version, 0::BIGINT AS pending, 0::BIGINT AS claimed, count(*) AS done, 0::BIGINT AS dead, 0::BIGINT AS human_overrides, 0::BIGINT AS stale FROM documents UNION ALL SELECT c, 1, CAST(count(*) FILTER (WHERE {byte('h', 3)} < 8 AND c = 'flag') AS BIGINT), 0, count(*) FILTER (WHERE {byte('h', 3)} >= 8), count(*) FILTER (WHERE {byte('h', 3)} < 8 AND c = 'shaky'), 0, 0 FROM {BOTH} GROUP BY c",
    "q_dead_jobs": f"SELECT 'shaky' AS column_name, doc_id, 1 AS attempts, 'server error' AS last_error FROM documents WHERE {byte(h('Which?'), 3)} < 8",
    "q_cost_by_column": f"SELECT c AS column_name, 1 AS version, 'hash-1' AS model, count(*) AS results, CAST(sum(length(text) // 4 + 10) AS BIGINT) AS prompt_tokens, 8 * count(*) AS completion_tokens, CAST(round(sum({COST}), 6) AS DOUBLE) AS cost_usd, CAST(round(avg(20 + {byte('h', 2)})) AS BIGINT) AS avg_latency_ms FROM (SELECT * FROM {BOTH} WHERE {byte('h', 3)} >= 8 UNION ALL SELECT 'derived', {h(PROMPT)}, text FROM documents) GROUP BY c",
    "q_budgets": f"SELECT CASE c WHEN 'derived' THEN 1 WHEN 'flag' THEN 2 ELSE 3 END::BIGINT AS def_id, CASE WHEN c = 'shaky' THEN 0.001::DOUBLE END AS budget_usd, CAST(round(sum({COST}), 6) AS DOUBLE) AS spent, CASE WHEN c = 'shaky' THEN CAST(round(CAST(0.001 AS DECIMAL(38,12)) - sum({COST}), 6) AS DOUBLE) END AS remaining, c = 'shaky' AND sum({COST}) >= 0.001 AS exhausted FROM (SELECT * FROM {BOTH} WHERE {byte('h', 3)} >= 8 UNION ALL SELECT 'derived', {h(PROMPT)}, text FROM documents) GROUP BY c",
    "q_budgets_exact": f"SELECT CASE c WHEN 'derived' THEN 1 WHEN 'flag' THEN 2 ELSE 3 END::BIGINT AS def_id, CAST(sum(CAST((length(text) // 4 + 10) * 5 + 160 AS DECIMAL(38,12))) / 10000000 AS DECIMAL(38,12)) AS spent, c = 'shaky' AND sum((length(text) // 4 + 10) * 5 + 160) >= 10000 AS exhausted FROM (SELECT * FROM {BOTH} WHERE {byte('h', 3)} >= 8 UNION ALL SELECT 'derived', {h(PROMPT)}, text FROM documents) GROUP BY c",
    "q_spent_month": "SELECT p AS period, round(CAST(coalesce(sum((user_id % 7 + 1) / 1000.0) FILTER (WHERE CASE p WHEN 'day' THEN event_id % 40 = 0 WHEN 'month' THEN event_id % 40 <= 14 ELSE true END), 0) AS DOUBLE), 6) AS spent FROM events, (SELECT unnest(['day', 'month', 'total']) AS p) GROUP BY p",
    "q_backfill_keyset": "SELECT o_orderkey, 'pending' AS status FROM orders ORDER BY o_orderkey LIMIT 2100",
    "q_backfill_all": "SELECT o_orderkey, 'pending' AS status FROM orders",
    "q_claim_topk": f"SELECT event_id FROM ({JOBS_SQL}) WHERE status = 'pending' AND wait_s <= 0 ORDER BY wait_s, event_id LIMIT 250",
    "q_backoff": f"SELECT event_id, CASE WHEN event_id % 7 = 0 OR attempts >= 5 THEN 'dead' ELSE 'pending' END AS status, attempts, CAST(CASE WHEN event_id % 7 = 0 OR attempts >= 5 THEN wait_s ELSE floor(30 * pow(2, attempts - 1)) END AS BIGINT) AS wait_s FROM ({JOBS_SQL}) WHERE status = 'claimed'",
    "q_reclaim": f"SELECT event_id, CASE WHEN attempts >= 4 THEN 'dead' ELSE 'pending' END AS status, attempts FROM ({JOBS_SQL}) WHERE status = 'claimed' AND wait_s < -300",
    "q_retry_dead": f"SELECT event_id, 'pending' AS status, CASE WHEN attempts = 2 THEN 9 ELSE 0 END AS attempts FROM ({JOBS_SQL}) WHERE status = 'dead'",
    "q_next_ready": f"SELECT CAST(min(wait_s) AS BIGINT) AS seconds FROM ({JOBS_SQL}) WHERE status = 'pending' AND wait_s > 0",
    "q_progress": f"SELECT count(*) FILTER (WHERE c = 'flag' AND {byte('h', 3)} < 8) AS pending, 0::BIGINT AS claimed, CAST(count(*) FILTER (WHERE {byte('h', 3)} >= 8) + {FILLED} AS BIGINT) AS done, count(*) FILTER (WHERE c = 'shaky' AND {byte('h', 3)} < 8) AS dead FROM {BOTH}",
    "q_top_errors": "SELECT 'boom' AS last_error, count(*) AS n FROM events WHERE event_type = 'error'",
    "q_decision_fanout": "SELECT doc_id, call, CASE call WHEN 0 THEN 16 ELSE 3 END::BIGINT AS questions FROM documents, (SELECT unnest([0, 1])::BIGINT AS call)",
    "q_lanes": "SELECT unnest(['decision', 'embedding', 'llm']) AS backend, count(*) AS written, count(*) AS cells FROM documents",
    "q_drop_column": "SELECT doc_id, 'cancelled' AS outcome, 0::BIGINT AS left_over FROM documents",
    "q_questions_per_call": "SELECT d AS def_id, count(*) AS results, 3.0::DOUBLE AS questions_per_call, 0::BIGINT AS retries FROM documents, (SELECT unnest([1, 2, 3])::BIGINT AS d) GROUP BY d",
    "q_embed_batches": "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks, 0::BIGINT AS stored_values FROM documents",
    "q_similar_topk": "SELECT e.vec_id, round(CAST(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE), 4) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id LIMIT 20",
    "q_accuracy": f"SELECT count(*) AS n, round(avg(CAST(pred = gold AS INT)), 4) AS accuracy FROM ({PRED_SQL})",
    "q_agreement": f"SELECT count(*) AS n, round(avg(CAST(pred = b AS INT)), 4) AS agreement, round(avg(CAST(pred = gold AS INT)) FILTER (WHERE pred = b), 4) AS accuracy_when_agree, count(*) FILTER (WHERE pred <> b) AS disagreements FROM ({PRED_SQL})",
    "q_calibration": f"SELECT CASE WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.7 THEN '0.5-0.7' WHEN confidence < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END AS bucket, count(*) AS n, round(avg(CAST(pred = gold AS INT)), 4) AS accuracy FROM ({PRED_SQL}) GROUP BY bucket",
    "q_per_class": f"SELECT gold, count(*) AS n, round(avg(CAST(pred = gold AS INT)), 4) AS accuracy FROM ({PRED_SQL}) GROUP BY gold",
    "q_confusions": f"SELECT gold, pred, count(*) AS n FROM ({PRED_SQL}) WHERE pred <> gold GROUP BY gold, pred ORDER BY n DESC, gold, pred LIMIT 10",
    "q_multi_accuracy": f"SELECT count(*) AS n, round(avg(CAST(doc_id % 2 = 0 OR pred = gold AS INT)), 4) AS accuracy FROM ({PRED_SQL})",
    "q_stratified_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 25",
    "q_prune": "SELECT 'result' AS kept, doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 90 <= 30 UNION ALL SELECT 'job', doc_id FROM documents WHERE doc_id % 90 <= 7",
    "q_json_extract": "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events",
    "q_html_title": "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages",
    "q_replies": f"""SELECT o_orderkey, CASE WHEN error IS NULL THEN o_orderpriority END AS value, CASE WHEN error IS NULL THEN CAST(0.5 AS DOUBLE) END AS confidence, error FROM (
        SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 9 WHEN 2 THEN 'reply: no confidence' WHEN 3 THEN 'reply: other fields than asked for' WHEN 5 THEN 'value: not of type string'
            WHEN 6 THEN 'reply: not JSON' WHEN 7 THEN 'reply: not of type object' WHEN 8 THEN 'value: not of type string'
            ELSE CASE WHEN o_orderpriority NOT IN ({', '.join(repr(x) for x in PRIORITIES)}) THEN 'value: not an allowed value' WHEN o_orderkey % 9 = 4 AND o_orderkey > 1 THEN 'confidence: more than 1' END END AS error FROM orders) t""",
    "q_stream_equals_batch": f"SELECT event_id, {label(h(PROMPT, 'event_type'))} AS derived FROM events",
    "q_stream_redefined": f"SELECT event_id, {label(h(PROMPT_2, 'event_type'))} AS derived, {byte(h('Is it?', 'event_type'), 0)} % 2 = 0 AS flag, 0 AS stale FROM events",
    "q_timers": f"SELECT doc_id, {label(h(PROMPT))} AS derived, CASE WHEN {byte(h(PROMPT), 3)} < 8 THEN 4 ELSE 1 END AS attempts, 'done' AS status FROM documents",
    "q_disable_enable": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) SELECT 'off' AS when, o_orderkey, 'claimed' AS status, 150 AS waiting FROM o WHERE r <= 150 UNION ALL SELECT 'on', o_orderkey, CASE WHEN r <= 150 THEN 'claimed' ELSE 'pending' END, 150 FROM o WHERE r <= 300",
    "q_retry_dead_rows": f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'dead' END AS status, CASE WHEN event_id % 5 = 0 THEN 0 ELSE attempts END AS attempts FROM ({JOBS_SQL}) WHERE status = 'dead'",
    "q_decision_siblings": "SELECT d AS def_id, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10), (SELECT unnest([1, 2])::BIGINT AS d)",
    "q_forget_missing": "SELECT 'some' AS when, doc_id FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT 'history', doc_id FROM documents",
    "q_prune_bounded": "SELECT 'results' AS what, count(*) - least(100, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 90 > 30)) AS n FROM documents UNION ALL SELECT 'jobs', count(*) - least(100, count(*) FILTER (WHERE doc_id % 90 > 7)) FROM documents UNION ALL SELECT 'jobs after all', count(*) FILTER (WHERE doc_id % 90 <= 7) FROM documents",
    "q_sources": "SELECT kind, doc_id, lang, sha256(text) AS text_hash FROM documents, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS kind)",
    "q_change_source": "SELECT event_id, CASE WHEN event_id % 14 = 0 THEN event_type || ' again' ELSE event_type END AS event_type FROM events WHERE event_id % 7 <> 0 OR event_id % 14 = 0",
    "q_failure_audit_naive": f"""WITH t AS (SELECT doc_id, text, text || ' edited' AS new, CASE WHEN doc_id % 10 = 3 THEN text ELSE text || ' edited' END AS seen, doc_id % 33 = 7 AS human FROM documents),
        v AS (SELECT CASE WHEN doc_id % 17 <> 5 THEN CASE WHEN doc_id % 7 = 2 THEN {label(h(PROMPT, 'seen'))} ELSE {label(h(PROMPT_2, 'seen'))} END END AS got, CASE WHEN human THEN 'by hand' ELSE {label(h(PROMPT_2, 'new'))} END AS want, {label(h(PROMPT_2, 'text'))} AS old_text, {label(h(PROMPT, 'new'))} AS old_prompt, human FROM t)
        SELECT count(*) FILTER (WHERE NOT human AND got IS NULL) AS missing, count(*) FILTER (WHERE NOT human AND got <> want) AS wrong, count(*) FILTER (WHERE NOT human AND got <> want AND got <> old_prompt AND got = old_text) AS wrong_old_text, count(*) FILTER (WHERE NOT human AND got <> want AND got = old_prompt) AS wrong_old_prompt, count(*) FILTER (WHERE human AND got IS DISTINCT FROM want) AS fixes_overwritten FROM v""",
    "q_failure_audit": "SELECT 0::BIGINT AS missing, 0::BIGINT AS wrong, 0::BIGINT AS wrong_old_text, 0::BIGINT AS wrong_old_prompt, 0::BIGINT AS fixes_overwritten",
}


@lru_cache(maxsize=1)
def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("q_") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
