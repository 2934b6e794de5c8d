"""The worker's side as set-wise transforms: claim, complete, fail, reclaim, prune, and the management of single rows. `now` is always given."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derivia.functions.keys import row_key, source_hash, source_text, value_error
from derivia.operators.capture import KEY, backfill_step, by_definition, enqueued, is_live, keyed, retired
from derivia.plans.catalog import Definition
from derivia.plans.state import FEW_ROWS, RESULTS, SPEND, State, conform, counted, materialized

#: What tells the newest of a row's dead jobs.
NEWEST = ("seq", "updated_at", "attempts", "last_error")
CLAIMED = "def_id long, row_key string, version int, source_hash string, text string, attempts int"
COMPUTED = "def_id long, row_key string, source_hash string, value string, confidence float, model string, prompt_tokens double, completion_tokens double, cost double, latency_ms int, details string, error string, retryable boolean, rate_limited boolean"


def period_start(period: Column | str, now: dt.datetime) -> Column:
    """First UTC day that counts in a budget period."""
    day = F.lit(now.date())
    p = F.lit(period) if isinstance(period, str) else period
    return F.when(p == "day", day).when(p == "month", F.trunc(day, "month")).otherwise(F.lit(dt.date(1900, 1, 1)))


def spent(state: State, def_id: int, period: str, now) -> Column:
    """USD spent in the period: 0 where nothing was."""
    rows = state.spend.where((F.col("def_id") == def_id) & (F.col("day") >= period_start(period, now)))
    return rows.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("spent"))


def budget_use(state: State, now) -> DataFrame:
    """def_id, spent in the definition's period, total; one row for each definition."""
    defs = state.defs().select("def_id", "budget_usd", "budget_period", "deleted")
    per = state.spend.groupBy("def_id", "day").agg(F.sum("cost").alias("cost"))
    in_period = F.when(F.col("day") >= period_start(F.col("budget_period"), now), F.col("cost"))
    return defs.join(per, "def_id", "left").groupBy("def_id", "budget_usd", "budget_period", "deleted").agg(F.coalesce(F.sum(in_period), F.lit(0)).alias("spent"), F.coalesce(F.sum("cost"), F.lit(0)).alias("total"))


def open_definitions(state: State, now, backends: list[str] | None = None) -> set[int]:
    """Ids of definitions that may be claimed: enabled, present, of the backends, and not over budget (a budget of 0 is used up at once)."""
    over = {r["def_id"] for r in budget_use(state, now).where(F.coalesce(F.col("spent") >= F.col("budget_usd"), F.lit(False))).collect()}
    return {d.def_id for d in state.catalog.defs if d.enabled and not d.deleted and d.def_id not in over and (not backends or d.current.backend in backends)}


def claimable(state: State, now, open_ids: set[int]) -> DataFrame:
    return state.jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now)) & F.col("def_id").isin(*open_ids, -1))


def picked(state: State, now, open_ids: set[int], batch_size: int | None) -> DataFrame:
    """The jobs to claim: the first by (next_attempt_at, when queued, key), and ready decision jobs on the same rows for the same model, whatever their definition."""
    ready = claimable(state, now, open_ids)
    if batch_size is None:
        return ready
    first = ready.orderBy("next_attempt_at", "seq", "def_id", "row_order").limit(batch_size)
    decisions = [d for d in state.catalog.defs if d.def_id in open_ids and d.current.backend == "decision"]
    if not decisions:
        return first
    out = first = materialized(first, "picked")
    for same in {(d.table, d.current.model) for d in decisions}:
        ids = [d.def_id for d in decisions if (d.table, d.current.model) == same]
        rows = first.where(F.col("def_id").isin(ids)).select("row_key").distinct()
        out = out.union(ready.where(F.col("def_id").isin(ids)).join(rows, "row_key", "left_semi").select(*first.columns))
    return out.distinct()


def claim(state: State, tables: dict[str, DataFrame], worker: str, now, batch_size: int | None = 20, backends: list[str] | None = None) -> tuple[State, DataFrame]:
    """Claim ready jobs and read their sources as they are now; jobs whose row is gone are dropped. Without a batch size all ready jobs are claimed, in one pass.

    Definitions on the same sources of a table share one scan of it; those of tables that aren't given wait.
    What is written are the claimed jobs.
    """
    ids = open_definitions(state, now, backends)
    defs = [d for d in state.catalog.defs if d.def_id in ids and d.table in tables]
    ids = {d.def_id for d in defs}
    if not defs:
        return state, state.jobs.sparkSession.createDataFrame([], CLAIMED)
    places = {p: k for k, p in enumerate(dict.fromkeys((d.table, d.pk, d.sources) for d in defs))}
    read = [tables[t].select(F.lit(k).alias("_place"), row_key(pk).alias("row_key"), source_hash(s).alias("_now"), source_text(s, dict(tables[t].dtypes)).alias("text")) for (t, pk, s), k in places.items()]
    keys = picked(state, now, ids, batch_size).withColumn("_place", by_definition({d.def_id: places[d.table, d.pk, d.sources] for d in defs}))
    found = keys.join(reduce(DataFrame.union, read), ["_place", "row_key"], "left").withColumn("version", by_definition({d.def_id: d.current.number for d in defs}))
    found = counted(found.drop("_place"), "claimed")
    new = {"status": F.lit("claimed"), "attempts": F.col("attempts") + 1, "claimed_by": F.lit(worker), "claimed_at": F.lit(now), "claimed_version": F.col("version"), "source_hash": F.coalesce("_now", "source_hash"), "_gone": F.col("_now").isNull()}
    state = state.changed({"jobs": found.n}, jobs=found.rows.withColumns(new))
    return state, found.rows.where("_now is not null").select(*KEY, "version", F.col("_now").alias("source_hash"), "text", (F.col("attempts") + 1).alias("attempts"))


def one_each(computed: DataFrame) -> DataFrame:
    """One answer for each job, however often it was delivered: one without an error before others, then by its fields."""
    others = [c for c in computed.columns if c not in KEY]
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("error").isNotNull(), *others))
    return computed.withColumn("_at", at).where("_at = 1").drop("_at")


def classified(state: State, computed: DataFrame) -> DataFrame:
    """computed plus `outcome`: cancelled, rejected (its error set), failed, stale_requeued, held or written; the job, and the result that was current, as structs `_job` and `_old`."""
    jobs = state.jobs.where("status = 'claimed'")
    jobs = jobs.select(*KEY, F.struct(*jobs.columns).alias("_job"), F.col("source_hash").alias("job_hash"), "claimed_version")
    old = state.results.where("is_current").select(*KEY, F.struct(*state.results.columns).alias("_old"))
    defs = F.broadcast(state.defs().select("def_id", F.col("version").alias("now_version"), "deleted", "backend", "threshold", "policy"))
    if computed.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        # of few answers the jobs and results are found without a shuffle of all jobs and results
        keys = F.broadcast(computed.select(*KEY).distinct())
        jobs, old = jobs.join(keys, KEY, "left_semi"), old.join(keys, KEY, "left_semi")
    c = one_each(computed).join(jobs, KEY, "left").join(old, KEY, "left").join(defs, "def_id", "left")
    # what claims can refer to: versions that waited or were claimed since; one check for each different schema
    checks: dict[tuple, list[tuple[int, int]]] = {}
    for d in state.catalog.defs:
        for v in d.versions:
            checks.setdefault((d.output_type, json.dumps(v.schema)), []).append((d.def_id, v.number))
    place = {pair: k for k, pairs in enumerate(checks.values()) for pair in pairs}
    which = computed.sparkSession.createDataFrame([(d, v, k) for (d, v), k in place.items()] or [], "def_id long, claimed_version int, _check int")
    c = c.join(F.broadcast(which), ["def_id", "claimed_version"], "left")
    wrong: Column = F.lit(None).cast("string")
    for k, (kind, schema) in enumerate(checks):
        wrong = F.when(F.col("_check") == k, value_error(kind, json.loads(schema), F.col("value"))).otherwise(wrong)
    c = c.withColumn("wrong", wrong).drop("_check")
    low = F.col("backend").isin("llm", "decision") & (F.col("confidence") < F.col("threshold").cast("float")) & (F.col("policy") == "hold")
    outcome = (
        F.when(F.col("job_hash").isNull(), "cancelled").when(F.col("error").isNotNull(), "failed").when(F.col("wrong").isNotNull(), "rejected")
        .when((F.col("job_hash") != F.col("source_hash")) | (F.col("claimed_version") != F.col("now_version")), "stale_requeued")
        .when(F.col("deleted"), "cancelled_done").when(F.coalesce(low, F.lit(False)), "held").otherwise("written")
    )
    return c.withColumn("outcome", outcome).withColumn("error", F.coalesce("error", "wrong")).withColumn("retryable", F.col("wrong").isNull() & F.coalesce("retryable", F.lit(True)))


def complete(state: State, computed: DataFrame, now) -> tuple[State, DataFrame]:
    """Apply computed values (COMPUTED; of several answers for a job one counts). Returns the state and the outcomes.

    One table is written, a row for each answer; what changes in jobs, results, cells and spend is read
    from it. computed is read once.
    """
    written = counted(classified(state, computed), "outcomes")
    c = written.rows
    kept = c.where(F.col("outcome").isin("stale_requeued", "held", "written"))
    current = F.col("outcome").isin("held", "written")
    vector = [d.def_id for d in state.catalog.defs if d.output_type in ("vector", "halfvec")]
    versions = c.sparkSession.createDataFrame([(d.def_id, v.number, v.model) for d in state.catalog.defs for v in d.versions], "def_id long, claimed_version int, _model string")
    rows = kept.join(F.broadcast(versions), ["def_id", "claimed_version"], "left").select(
        *KEY, F.col("claimed_version").alias("version"), "source_hash", F.when(~F.col("def_id").isin(*vector, -1), F.col("value")).alias("value"), "confidence", F.lit("model").alias("source"), current.alias("is_current"), (F.col("outcome") == "written").alias("written"),
        F.coalesce("model", "_model").alias("model"), "prompt_tokens", "completion_tokens", "cost", "latency_ms", "details", F.lit(state.seq).alias("seq"), F.lit(now).alias("created_at"),
    )
    old = c.where(current & F.col("_old").isNotNull()).select("_old.*").withColumn("is_current", F.lit(False))
    # a row for each definition, which is what spend has for a day
    more = kept.groupBy("def_id").agg(F.coalesce(F.sum(F.col("cost").cast("decimal(38,12)")), F.lit(0)).alias("cost"), F.count(F.lit(1)).alias("results"))
    before = state.spend.where(F.col("day") == F.lit(now.date())).select("def_id", "cost", "results")
    spent_now = conform(more, SPEND).union(conform(before, SPEND)).groupBy("def_id").agg(F.sum("cost").alias("cost"), F.sum("results").alias("results")).collect()
    spend = c.sparkSession.createDataFrame([(r["def_id"], now.date(), r["cost"], r["results"]) for r in spent_now], SPEND)
    wrong = F.col("outcome").isin("failed", "rejected")
    jobs = c.where("outcome <> 'cancelled'").select("_job.*", "outcome", F.when(wrong, F.coalesce(F.substring("error", 1, 2000), F.lit(""))).alias("_error"), "retryable")
    live = ~wrong
    again = F.col("outcome") == "stale_requeued"
    done = jobs.withColumns({"status": F.when(again, "pending").when(live, "done").otherwise(F.col("status")), "next_attempt_at": F.when(again, F.lit(now)).otherwise(F.col("next_attempt_at")), "claimed_version": F.when(again, None).otherwise(F.col("claimed_version")), "updated_at": F.when(live, F.lit(now)).otherwise(F.col("updated_at"))})
    sizes = {"jobs": written.n, "results": 2 * written.n, "cells": written.n, "spend": len(spent_now)}
    state = state.changed(sizes, jobs=backed_off(state, done, now), results=rows.unionByName(conform(old, RESULTS)), cells=c.where("outcome = 'written'").select(*KEY, "value"), spend=spend)
    return state, c.select(*KEY, F.regexp_replace("outcome", "_done$", "").alias("outcome"), "error")


def failed(state: State, errors: DataFrame, now) -> State:
    """Failed claims (def_id, row_key, error, retryable): dead when final or out of attempts, else pending after base * 2^(attempts - 1) seconds."""
    told = errors.select(*KEY, F.substring("error", 1, 2000).alias("_error"), "retryable")
    return state.changed(jobs=backed_off(state, state.jobs.where("status = 'claimed'").join(told, KEY), now))


def backed_off(state: State, jobs: DataFrame, now) -> DataFrame:
    """Jobs after the failures in their columns `_error` and `retryable`."""
    j = jobs.join(F.broadcast(state.defs().select("def_id", "max_attempts", "backoff")), "def_id", "left")
    hit = (F.col("status") == "claimed") & F.col("_error").isNotNull()
    dead = hit & (~F.col("retryable") | (F.col("attempts") >= F.col("max_attempts")))
    wait = F.make_dt_interval(secs=(F.col("backoff") * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("decimal(18,6)"))
    return j.withColumns({"next_attempt_at": F.when(hit & ~dead, F.lit(now) + wait).otherwise(F.col("next_attempt_at")), "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")), "status": F.when(dead, "dead").when(hit, "pending").otherwise(F.col("status")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))})


def reclaimed(state: State, now, timeout: dt.timedelta = dt.timedelta(minutes=5), worker: str | None = None) -> State:
    """Claims older than the timeout, or all of one worker, go back, or die when out of attempts; their turn stays."""
    which = F.col("claimed_at") < F.lit(now - timeout) if worker is None else F.col("claimed_by") == worker
    late = state.jobs.where((F.col("status") == "claimed") & which).join(F.broadcast(state.defs().select("def_id", "max_attempts")), "def_id", "left")
    return state.changed(jobs=late.withColumns({"last_error": F.lit("reclaimed: the worker gave no answer in time"), "updated_at": F.lit(now), "status": F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("pending")}))


def prune_counts(state: State, now, limit: int | None = 10_000, jobs_older: dt.timedelta = dt.timedelta(days=7)) -> tuple[DataFrame, DataFrame]:
    """Keys of the results and jobs that may go: history beyond its definition's retention, and old finished jobs; the oldest first."""
    keep = F.broadcast(state.defs().select("def_id", "retention_days"))
    old = state.results.where("not is_current").join(keep, "def_id").where(F.col("created_at") < F.lit(now) - F.make_dt_interval(days=F.col("retention_days"))).select(*KEY, "seq", "created_at")
    done = state.jobs.where((F.col("status") == "done") & (F.col("updated_at") < F.lit(now - jobs_older))).select(*KEY, "seq", "updated_at")
    if limit is not None:
        old, done = old.orderBy("created_at", "seq", *KEY).limit(limit), done.orderBy("updated_at", "seq", *KEY).limit(limit)
    return old, done


def pruned(state: State, now, limit: int | None = 10_000, jobs_older: dt.timedelta = dt.timedelta(days=7)) -> State:
    """Without what may go; current results, dead jobs and spend stay."""
    old, done = prune_counts(state, now, limit, jobs_older)
    return state.changed(results=old.withColumn("_gone", F.lit(True)), jobs=done.withColumn("_gone", F.lit(True)))


def pruned_jobs(state: State, now, older: dt.timedelta = dt.timedelta(days=7)) -> State:
    """Without any finished job older than that, however many they are."""
    done = state.jobs.where((F.col("status") == "done") & (F.col("updated_at") < F.lit(now - older)))
    return state.changed(jobs=done.withColumn("_gone", F.lit(True)))


def retried_dead(state: State, d: Definition, now, keys: DataFrame | None = None) -> State:
    """Dead jobs become pending with no attempts, the newest of a row; those of rows with a live job go. keys (row_key) narrows it to rows."""
    mine = (F.col("def_id") == d.def_id) & (F.col("status") == "dead")
    dead = state.jobs.where(mine)
    if keys is not None:
        dead = dead.join(keys.select("row_key"), "row_key", "left_semi")
    newest = dead.groupBy(*KEY).agg(F.max(F.struct(*NEWEST)).alias("newest"))
    live = state.jobs.where(is_live() & (F.col("def_id") == d.def_id)).select(*KEY, F.lit(True).alias("_live"))
    j = state.jobs.join(newest, KEY, "left").join(live, KEY, "left")
    hit = mine & F.col("newest").isNotNull()
    j = j.where(~hit | (F.col("_live").isNull() & F.struct(*NEWEST).eqNullSafe(F.col("newest"))))
    # of jobs that are equal in all of that one becomes live
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    j = j.where(~hit).unionByName(j.where(hit).withColumn("_at", at).where("_at = 1").drop("_at"))
    return state.put(jobs=j.withColumns({"attempts": F.when(hit, 0).otherwise(F.col("attempts")), "next_attempt_at": F.when(hit, F.lit(now)).otherwise(F.col("next_attempt_at")), "status": F.when(hit, "pending").otherwise(F.col("status"))}))


def pinned(state: State, d: Definition) -> DataFrame:
    return state.results.where((F.col("def_id") == d.def_id) & F.col("is_current") & (F.col("source") == "human")).select("row_key")


def requeued(state: State, d: Definition, rows: DataFrame, now) -> State:
    """Queue the given rows of the table, computed or not; not where a person's value stands or the column is off."""
    if not d.enabled or d.deleted:
        return state
    return enqueued(state, keyed(d, rows).join(pinned(state, d), "row_key", "left_anti"), now)


def unpinned(state: State, d: Definition, keys: DataFrame, rows: DataFrame, now) -> State:
    """Let go of people's values of the keys (row_key, as stored) and queue those rows that exist."""
    free = materialized(keys.select("row_key").join(pinned(state, d), "row_key", "left_semi"), "unpin")
    state = state.changed(results=retired(state, free.select(F.lit(d.def_id).cast("long").alias("def_id"), "row_key")))
    return enqueued(state, keyed(d, rows).join(free, "row_key", "left_semi"), now) if d.enabled else state


def redefined(state: State, table: str, column: str, now, **changes) -> State:
    """A new version: waiting jobs start anew, claimed ones end as stale; the scan of the table starts again."""
    catalog, d = state.catalog.update_column(table, column, **changes)
    mine = state.jobs.where((F.col("def_id") == d.def_id) & (F.col("status") == "pending"))
    jobs = mine.withColumns({"attempts": F.lit(0), "next_attempt_at": F.lit(now), "last_error": F.lit(None)})
    return replace(state.changed(jobs=jobs), catalog=catalog)


def disabled(state: State, table: str, column: str) -> State:
    """Off: waiting jobs go, claimed ones finish as ever."""
    d = state.catalog.find(table, column)
    state = state.changed(jobs=state.jobs.where((F.col("def_id") == d.def_id) & (F.col("status") == "pending")).withColumn("_gone", F.lit(True)))
    return replace(state, catalog=state.catalog.set_enabled(table, column, False))


def enabled(state: State, table: str, column: str, rows: DataFrame, now) -> tuple[State, int]:
    """On again: the scan of the table starts anew with a first chunk. Returns how many jobs that left waiting."""
    state = replace(state, catalog=state.catalog.set_enabled(table, column, True))
    state, d, _ = backfill_step(state, state.catalog.find(table, column), rows, now)
    return state, state.jobs.where((F.col("def_id") == d.def_id) & (F.col("status") == "pending")).count()


def dropped(state: State, table: str, column: str, drop_target: bool = False) -> State:
    """Gone from the catalog's live columns; waiting and claimed jobs go, so that an answer still on its way is cancelled. History and spend stay, and the cells unless the target is dropped, too."""
    d = state.catalog.find(table, column)
    state = state.changed(jobs=state.jobs.where((F.col("def_id") == d.def_id) & is_live()).withColumn("_gone", F.lit(True)))
    if drop_target:
        state = state.put(cells=state.cells.where(F.col("def_id") != d.def_id))
    return replace(state, catalog=state.catalog.drop_column(table, column))
