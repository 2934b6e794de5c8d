"""What one reads about the state: columns, stale rows, review, failures, cost, budgets, and the table with its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.functions.keys import row_key, typed_value
from derivia.operators.contract import budget_use
from derivia.plans.catalog import Definition
from derivia.plans.state import State


def live_defs(state: State) -> DataFrame:
    return F.broadcast(state.defs().where("not deleted").withColumnRenamed("version", "current_version"))


def columns(state: State) -> DataFrame:
    """A row for each live column: version, jobs by status, people's values, stale values, where its scan is."""
    tell = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    jobs = state.jobs.groupBy("def_id").agg(*[tell(s) for s in ("pending", "claimed", "done", "dead")])
    current = state.results.where("is_current").join(live_defs(state), "def_id")
    human = F.col("source") == "human"
    counts = current.groupBy("def_id").agg(F.sum(F.when(human, 1).otherwise(0)).alias("human_overrides"), F.sum(F.when(~human & (F.col("version") != F.col("current_version")), 1).otherwise(0)).alias("stale"))
    out = state.defs().where("not deleted").join(jobs, "def_id", "left").join(counts, "def_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("def_id", "table_name", "column_name", "version", "backend", "enabled", *[zero(c) for c in ("pending", "claimed", "done", "dead", "human_overrides", "stale")], "backfill_pending", "backfill_scanned")


def stale_rows(state: State) -> DataFrame:
    c = state.results.where("is_current and source = 'model'").join(live_defs(state), "def_id").where("version <> current_version")
    return c.select("def_id", "table_name", "column_name", "row_key", "value", "version", "current_version")


def needs_review(state: State) -> DataFrame:
    """Current model values of low confidence, written and held; both sides are compared as 32-bit floats."""
    c = state.results.where("is_current and source = 'model' and confidence is not null").join(live_defs(state), "def_id").where(F.col("confidence") < F.col("threshold").cast("float"))
    return c.select("def_id", "table_name", "column_name", "row_key", "value", "confidence", "written")


def dead_jobs(state: State) -> DataFrame:
    return state.jobs.where("status = 'dead'").join(F.broadcast(state.defs().select("def_id", "table_name", "column_name")), "def_id").select("def_id", "table_name", "column_name", "row_key", "attempts", "last_error", "updated_at")


def cost_by_column(state: State) -> DataFrame:
    """Model results, replaced ones and those of dropped columns too, by column, version and model."""
    whole = lambda c, name: F.round(c, 0).cast("long").alias(name)
    per = state.results.where("source = 'model'").groupBy("def_id", "version", "model").agg(F.count(F.lit(1)).alias("results"), whole(F.sum("prompt_tokens"), "prompt_tokens"), whole(F.sum("completion_tokens"), "completion_tokens"), F.sum("cost").cast("double").alias("cost_usd"), whole(F.avg("latency_ms"), "avg_latency_ms"))
    return per.join(F.broadcast(state.defs().select("def_id", "table_name", "column_name")), "def_id")


def budgets(state: State, now) -> DataFrame:
    use = budget_use(state, now).where("not deleted")
    spent, cap = F.col("spent").cast("double"), F.col("budget_usd")
    return use.select("def_id", "budget_usd", "budget_period", spent.alias("spent"), F.col("total").cast("double").alias("total"), (cap - spent).alias("remaining"), F.coalesce(spent >= cap, F.lit(False)).alias("exhausted"))


def status(state: State, now) -> DataFrame:
    return columns(state).join(budgets(state, now), "def_id")


def with_values(state: State, d: Definition, rows: DataFrame) -> DataFrame:
    """The table with the column's cells in its own type."""
    cells = state.cells.where(F.col("def_id") == d.def_id).select(F.col("row_key").alias("_key"), typed_value(d.output_type, F.col("value")).alias(d.column))
    return rows.drop(d.column).withColumn("_key", row_key(d.pk)).join(cells, "_key", "left").drop("_key")
