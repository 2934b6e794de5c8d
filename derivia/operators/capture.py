"""What table changes mean for derived columns: which rows need work, which values people set, which rows are gone."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derivia.functions.keys import as_json, keyset_after, row_key, row_order, source_hash
from derivia.operators import scan
from derivia.plans.catalog import Definition
from derivia.plans.state import FEW_ROWS, RESULTS, Layer, State, conform, counted, deleted_path

LIVE = ("pending", "claimed")
KEY = ["def_id", "row_key"]


def is_live() -> Column:
    return F.col("status").isin(*LIVE)


def keyed(d: Definition, rows: DataFrame) -> DataFrame:
    """def_id, row_key, row_order, source_hash of each row; only key and sources are read."""
    return rows.select(F.lit(d.def_id).cast("long").alias("def_id"), row_key(d.pk).alias("row_key"), row_order(d.pk, dict(rows.dtypes)).alias("row_order"), source_hash(d.sources).alias("source_hash"))


def keyed_all(defs: list[Definition], rows: DataFrame) -> DataFrame:
    """keyed of several definitions of one table with one key, in one scan; a set of sources is hashed once."""
    pk = defs[0].pk
    hashes = {s: f"_hash_{k}" for k, s in enumerate(dict.fromkeys(d.sources for d in defs))}
    once = rows.select(row_key(pk).alias("row_key"), row_order(pk, dict(rows.dtypes)).alias("row_order"), *[source_hash(s).alias(h) for s, h in hashes.items()])
    each = F.explode(F.array(*[F.struct(F.lit(d.def_id).cast("long").alias("def_id"), F.col(hashes[d.sources]).alias("source_hash")) for d in defs]))
    return once.select("row_key", "row_order", each.alias("_each")).select("_each.def_id", "row_key", "row_order", "_each.source_hash")


def by_definition(values: dict[int, object]) -> Column:
    """The value that belongs to the row's def_id; there are as many as declarations."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col("def_id")]


def check_key(rows: DataFrame, pk) -> None:
    """Raise unless the key columns are never null and never repeat."""
    bad = rows.groupBy(*pk).count().where(F.col("count").__gt__(1) | F.expr(" or ".join(f"`{c}` is null" for c in pk)))
    if not bad.isEmpty():
        raise ValueError(f"{', '.join(pk)} isn't a key: it is null or repeats")


def declared(state: State, rows: DataFrame, table: str, column: str, pk, sources, output_type: str, **options) -> tuple[State, Definition]:
    """A new derived column of a table whose rows are at hand: names and types are checked against them, and that pk is a key, unless another column of the table has the same."""
    catalog, d = state.catalog.add_column(table, column, pk, sources, output_type, fields=dict(rows.dtypes), **options)
    if not any((x.table, x.pk, x.deleted) == (table, d.pk, False) for x in state.catalog.defs):
        check_key(rows, d.pk)
    return replace(state, catalog=catalog), d


def of_keys(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Rows of the keys (def_id, row_key), which are few: found without a shuffle of all rows. No keys: all rows."""
    return rows if keys is None else rows.join(F.broadcast(keys.select(*KEY).distinct()), KEY, "left_semi")


def enqueued(state: State, todo: DataFrame, now, few: DataFrame | None = None) -> State:
    """Queue rows (def_id, row_key, row_order, source_hash): a live job only gets the new hash, others become pending. What is written are these rows. few are their keys, if few."""
    t = todo.select(*KEY, F.col("row_order").alias("_order"), F.col("source_hash").alias("_hash"))
    rows = t.join(of_keys(state.jobs.where(is_live()), few), KEY, "left").where(~F.col("_hash").eqNullSafe(F.col("source_hash")))
    known = F.col("status").isNotNull()
    return state.changed(jobs=rows.select(
        *KEY, F.coalesce("row_order", "_order").alias("row_order"), F.col("_hash").alias("source_hash"), F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("next_attempt_at", F.lit(now)).alias("next_attempt_at"), "claimed_by", "claimed_at", "claimed_version", "last_error", F.when(known, F.col("seq")).otherwise(F.lit(state.seq)).alias("seq"), F.coalesce("updated_at", F.lit(now)).alias("updated_at"),
    ))


def retired(state: State, keys: DataFrame) -> DataFrame:
    """The current results of the keys (def_id, row_key), current no more."""
    return state.results.where("is_current").join(keys.select(*KEY).distinct(), KEY, "left_semi").withColumn("is_current", F.lit(False))


def with_state(state: State, rows: DataFrame, name: str) -> Layer:
    """The rows, with the live job and the current result of their keys as structs `_job` and `_old`; written."""
    live = state.jobs.where(is_live()).select(*KEY, F.struct(*state.jobs.columns).alias("_job"))
    current = state.results.where("is_current").select(*KEY, F.struct(*state.results.columns).alias("_old"))
    return counted(rows.join(live, KEY, "left").join(current, KEY, "left"), name)


def without_jobs(found: DataFrame) -> DataFrame:
    return found.where("_job is not null").select("_job.*").withColumn("_gone", F.lit(True))


def without_current(found: DataFrame) -> DataFrame:
    return conform(found.where("_old is not null").select("_old.*").withColumn("is_current", F.lit(False)), RESULTS)


def needing_work(state: State, defs: list[Definition], keys: DataFrame, backfill: bool, few: DataFrame | None = None) -> DataFrame:
    """Rows of the definitions without a current value on their sources under the present version.

    A scan of the table passes over what people set; a change of sources only under the policy 'pin'.
    """
    current = of_keys(state.results.where(F.col("is_current") & F.col("def_id").isin([d.def_id for d in defs])), few)
    human = F.col("source") == "human"
    blocks = human & by_definition({d.def_id: backfill or d.config["override_policy"] == "pin" for d in defs})
    held = current.select(*KEY, F.col("source_hash").alias("_hash"), blocks.alias("_pinned"), (~human & (F.col("version") == by_definition({d.def_id: d.current.number for d in defs}))).alias("_now"))
    joined = keys.join(held, KEY, "left")
    fine = F.coalesce(F.col("_pinned") | (F.col("_now") & (F.col("_hash") == F.col("source_hash"))), F.lit(False))
    return joined.where(~fine).select(*KEY, "row_order", "source_hash")


def changed_rows(d: Definition, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys of rows that are new or whose sources changed."""
    old = keyed(d, before).select("row_key", F.col("source_hash").alias("_old"))
    return keyed(d, after).join(old, "row_key", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("source_hash"))).drop("_old")


def captured(state: State, d: Definition, before: DataFrame, after: DataFrame, now) -> State:
    """Apply the difference of two snapshots: queue what changed, take over values set by people, forget what is gone - in that order, so that a person's value wins."""
    if d.enabled and not d.deleted:
        state = enqueued(state, needing_work(state, [d], changed_rows(d, before, after), False), now)
    if d.column in before.columns and d.column in after.columns:
        was = before.select(row_key(d.pk).alias("row_key"), F.col(f"`{d.column}`").alias("_was"))
        own = as_json(d.output_type, F.col("_is"))
        is_ = after.select(row_key(d.pk).alias("row_key"), row_order(d.pk, dict(after.dtypes)).alias("row_order"), source_hash(d.sources).alias("source_hash"), F.col(f"`{d.column}`").alias("_is"))
        state = overridden(state, d, is_.join(was, "row_key").where(~F.col("_is").eqNullSafe(F.col("_was"))).select("row_key", "row_order", "source_hash", F.when(F.col("_is").isNotNull(), own).alias("value")), now)
    return forgotten(state, d, keyed(d, before).join(keyed(d, after).select("row_key"), "row_key", "left_anti"))


def captured_changes(state: State, d: Definition, changes: DataFrame, n: int, now) -> State:
    """captured, from a table's n changed rows at most, each key once: `_gone` tells deletes, `_known` rows that were there, `_changed` which of their columns are other than they were. No other row of the table is read."""
    rows = changes.where("not _gone")
    if d.enabled and not d.deleted:
        new = ~F.col("_known") | F.arrays_overlap("_changed", F.array(*map(F.lit, d.sources)))
        keys = keyed(d, rows.where(new))
        few = keys if n <= FEW_ROWS else None
        state = enqueued(state, needing_work(state, [d], keys, False, few), now, few)
    if d.column in changes.columns:
        own = F.when(F.col(f"`{d.column}`").isNotNull(), as_json(d.output_type, F.col(f"`{d.column}`")))
        by_people = rows.where(F.col("_known") & F.array_contains("_changed", d.column))
        state = overridden(state, d, by_people.select(row_key(d.pk).alias("row_key"), row_order(d.pk, dict(rows.dtypes)).alias("row_order"), source_hash(d.sources).alias("source_hash"), own.alias("value")), now)
    gone = changes.where("_gone")
    return state if gone.isEmpty() else forgotten(state, d, keyed(d, gone))


def overridden(state: State, d: Definition, values: DataFrame, now) -> State:
    """People's values (row_key, row_order, source_hash, value as JSON): they become current and end live jobs; null asks for a new computation instead."""
    found = with_state(state, values.select(F.lit(d.def_id).cast("long").alias("def_id"), "row_key", "row_order", "source_hash", "value"), "overrides")
    if not found.n:
        return state
    human = found.rows.where("value is not null")
    rows = human.select(*KEY, "source_hash", "value", F.lit("human").alias("source"), F.lit(True).alias("is_current"), F.lit(True).alias("written"), F.lit(state.seq).alias("seq"), F.lit(now).alias("created_at"))
    sizes = {"results": 2 * found.n, "cells": found.n, "jobs": found.n}
    state = state.changed(sizes, results=conform(rows, RESULTS).union(without_current(found.rows)), cells=found.rows.select(*KEY, "value", F.col("value").isNull().alias("_gone")), jobs=without_jobs(human))
    return enqueued(state, found.rows.where("value is null").select(*KEY, "row_order", "source_hash"), now) if d.enabled else state


def forgotten(state: State, d: Definition, gone: DataFrame) -> State:
    """Rows that no longer exist: nothing of theirs is current or live; history stays."""
    found = with_state(state, gone.select("def_id", "row_key"), "gone")
    if not found.n:
        return state
    sizes = {"results": found.n, "cells": found.n, "jobs": found.n}
    return state.changed(sizes, results=without_current(found.rows), jobs=without_jobs(found.rows), cells=found.rows.select(*KEY, F.lit(True).alias("_gone")))


def forgotten_missing(state: State, d: Definition, rows: DataFrame) -> State:
    """Forget every current result and live job whose row the table no longer has."""
    known = state.results.where(F.col("is_current") & (F.col("def_id") == d.def_id)).select(*KEY).union(state.jobs.where(is_live() & (F.col("def_id") == d.def_id)).select(*KEY)).distinct()
    return forgotten(state, d, known.join(keyed(d, rows).select("row_key"), "row_key", "left_anti"))


def backfill_step(state: State, d: Definition, rows: DataFrame, now, chunks: int = 1) -> tuple[State, Definition, int]:
    """Scan the next chunk, or so many at once, in key order and queue what needs work. The scan ends with a step that isn't full.

    The first step writes the table's keys and hashes clustered by the key; a step reads its chunks of that.
    """
    spark, size = rows.sparkSession, d.config["backfill_chunk"] * chunks
    if not scan.there(spark, d.backfill_scan):
        left = rows if d.backfill_cursor is None else rows.where(keyset_after(d.pk, d.backfill_cursor))
        keys = left.select(*[F.col(f"`{c}`") for c in d.pk], row_key(d.pk).alias("row_key"), row_order(d.pk, dict(rows.dtypes)).alias("row_order"), source_hash(d.sources).alias("source_hash"))
        d = replace(d, backfill_scan=scan.clustered(keys, d.pk, d.config["backfill_chunk"], d.backfill_scanned))
    part, n = scan.chunk_of(spark, d.backfill_scan, d.backfill_scanned, size)
    last = d.backfill_cursor
    if part is not None:
        last = tuple(part.agg(F.max(F.struct(*[F.col(f"`{c}`") for c in d.pk])).alias("last")).first()["last"])
        keys = part.select(F.lit(d.def_id).cast("long").alias("def_id"), "row_key", "row_order", "source_hash")
        few = keys if n <= FEW_ROWS else None
        state = enqueued(state, needing_work(state, [d], keys, True, few), now, few)
    more = n == size
    if not more:
        deleted_path(spark, d.backfill_scan["path"])
    d = replace(d, backfill_scanned=d.backfill_scanned + n, backfill_cursor=last, backfill_pending=more, backfill_scan=d.backfill_scan if more else None)
    return replace(state, catalog=state.catalog.put(d)), d, n


def stepped(state: State, d: Definition, rows: DataFrame, now, growth: int = 4) -> tuple[State, Definition]:
    """A running scan by chunks carried to its end, with a cursor after each step.

    A step looks up its rows among all queued jobs. With one chunk a step that takes the square of the table's
    rows; so each step takes `growth` times the chunks of the one before, and all look up about the table once.
    """
    chunks = 1
    while d.backfill_pending:
        state, d, _ = backfill_step(state, d, rows, now, chunks)
        state = state.materialized("jobs")
        chunks *= growth
    return state, d


def backfilled(state: State, d: Definition, rows: DataFrame, now) -> tuple[State, Definition]:
    """Scan the whole table in one pass: what Spark does where the reference design needs chunks."""
    state, (d,) = backfilled_all(state, [d], rows, now)
    return state, d


def backfilled_all(state: State, defs: list[Definition], rows: DataFrame, now) -> tuple[State, list[Definition]]:
    """backfilled for several definitions of one table: a scan for each key, one join with the results, one write of the jobs. All are queued at once."""
    if not defs:
        return state, []
    keys = reduce(DataFrame.union, [keyed_all([d for d in defs if d.pk == pk], rows) for pk in dict.fromkeys(d.pk for d in defs)])
    state = enqueued(state, needing_work(state, defs, keys, True), now).materialized("jobs")
    n = rows.count()
    defs = [replace(d, backfill_pending=False, backfill_scanned=n, backfill_scan=None) for d in defs]
    for d in defs:
        state = replace(state, catalog=state.catalog.put(d))
    return state, defs


def scanned(state: State, tables: dict[str, DataFrame], now, open_ids: set[int]) -> State:
    """Carry running scans of enabled definitions within budget to their end, those of a table together."""
    running = [d for d in state.catalog.defs if d.backfill_pending and d.enabled and not d.deleted and d.def_id in open_ids]
    for name in dict.fromkeys(d.table for d in running):
        state, _ = backfilled_all(state, [d for d in running if d.table == name], tables[name], now)
    return state


def driven(state: State, tables: dict[str, DataFrame], now, open_ids: set[int], steps: int = 10) -> State:
    """Continue running scans of enabled definitions within budget until a chunk of pending jobs waits, `steps` chunks at most."""
    for d in state.catalog.defs:
        if not (d.backfill_pending and d.enabled and not d.deleted and d.def_id in open_ids):
            continue
        for _ in range(steps):
            waiting = state.jobs.where((F.col("def_id") == d.def_id) & (F.col("status") == "pending")).limit(d.config["backfill_chunk"]).count()
            if not d.backfill_pending or waiting >= d.config["backfill_chunk"]:
                break
            state, d, _ = backfill_step(state, d, tables[d.table], now)
            state = state.materialized("jobs")
    return state
