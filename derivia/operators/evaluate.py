"""How good and how dear derived values are: accuracy, agreement, calibration, confusions, failures, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derivia.functions.keys import cosine_distance


def hit(pred: Column, gold: Column) -> Column:
    return (pred == gold).cast("int")


def accuracy(df: DataFrame) -> DataFrame:
    """df(pred, gold): share of right predictions among those made."""
    return df.where("pred is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit(F.col("pred"), F.col("gold"))), 4).alias("accuracy"))


def multi_accuracy(df: DataFrame) -> DataFrame:
    """df(pred, gold array): right is any of the accepted labels."""
    return df.where("pred is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.array_contains("gold", F.col("pred")).cast("int")), 4).alias("accuracy"))


def agreement(df: DataFrame) -> DataFrame:
    """df(a, b, gold): how often two models agree, and how good they are when they do."""
    same = F.col("a") == F.col("b")
    return df.where("a is not null and b is not null").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same.cast("int")), 4).alias("agreement"), F.round(F.avg(F.when(same, hit(F.col("a"), F.col("gold")))), 4).alias("accuracy_when_agree"), F.sum((~same).cast("int")).alias("disagreements"))


def calibration(df: DataFrame) -> DataFrame:
    """df(pred, gold, confidence) by confidence bucket."""
    c = F.col("confidence")
    bucket = F.when(c < 0.5, "<0.5").when(c < 0.7, "0.5-0.7").when(c < 0.9, "0.7-0.9").otherwise(">=0.9")
    return df.where("pred is not null and confidence is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit(F.col("pred"), F.col("gold"))), 4).alias("accuracy"))


def per_class(df: DataFrame) -> DataFrame:
    return df.where("pred is not null").groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit(F.col("pred"), F.col("gold"))), 4).alias("accuracy"))


def confusions(df: DataFrame, k: int = 10) -> DataFrame:
    return df.where("pred <> gold").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(k)


def failure_audit(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """actual(row_key, value), expected(row_key, value, old_text_value, old_prompt_value, human): what a run left wrong; all zero is the aim.

    Rows that a person has set count as overwritten fixes only, whatever else stands there; a wrong value
    that both an old prompt and an old text give counts for the prompt.
    """
    j = expected.join(actual.select("row_key", F.col("value").alias("got")), "row_key", "left")
    wrong = ~F.col("human") & (F.col("got") != F.col("value"))
    old_prompt = F.coalesce(F.col("got") == F.col("old_prompt_value"), F.lit(False))
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name)
    return j.agg(n(~F.col("human") & F.col("got").isNull(), "missing"), n(wrong, "wrong"), n(wrong & ~old_prompt & (F.col("got") == F.col("old_text_value")), "wrong_old_text"), n(wrong & old_prompt, "wrong_old_prompt"), n(F.col("human") & ~F.col("got").eqNullSafe(F.col("value")), "fixes_overwritten"))


def run_metrics(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per definition: cost of 1000 results, retries, mean latency, questions in a call."""
    r = results.where("source = 'model'").groupBy("def_id").agg(F.count(F.lit(1)).alias("results"), F.round(F.sum("cost").cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0)) * 1000, 6).alias("cost_per_1000"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"), F.round(F.avg(F.get_json_object("details", "$.questions_in_call").cast("double")), 2).alias("questions_per_call"))
    j = jobs.groupBy("def_id").agg(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"))
    return r.join(j, "def_id", "left")


def top_errors(jobs: DataFrame, k: int = 10) -> DataFrame:
    return jobs.where("last_error is not null").groupBy("last_error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "last_error").limit(k)


def progress(columns: DataFrame) -> DataFrame:
    """Whether anything is left to do over all columns."""
    return columns.agg(F.sum("pending").alias("pending"), F.sum("claimed").alias("claimed"), F.sum("done").alias("done"), F.sum("dead").alias("dead"), (~F.bool_or(F.col("backfill_pending") | (F.col("pending") + F.col("claimed") > 0))).alias("idle"))


def next_ready(jobs: DataFrame, now) -> DataFrame:
    """Seconds until the next waiting job may be claimed: 0 if one may now, null if none waits."""
    first = F.min("next_attempt_at").cast("double")
    return jobs.where("status = 'pending'").agg(F.when(first.isNotNull(), F.greatest(first - F.lit(now).cast("timestamp").cast("double"), F.lit(0.0))).alias("seconds"))


def stratified(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum, by the hash of the key."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n).drop("_at")


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows nearest to a query vector by cosine distance."""
    d = cosine_distance(F.col(vector), F.lit(query).cast("array<double>") if not isinstance(query, list) else F.array(*[F.lit(float(x)) for x in query]))
    return df.select(key, d.alias("distance")).where("distance is not null").orderBy("distance", key).limit(k)
