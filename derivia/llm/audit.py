"""Which filter removes what, in every order: five filters over whole texts, replayed in all 120 orders.

Direct relational replay: each document's five flags meet the broadcast table of orders, the five steps are
exploded, the first failing step decides, and conditional sums by (part, order, step) are combined on the
map side, so that a shuffle carries at most 600 rows for each part and task, however many documents a part
has. No text is shuffled: the first document of each text is found by the text's SHA-256.

The filters, and what fails them: A: under MIN_WORDS words; B: distinct words under MIN_DISTINCT per cent of
words; C: capitals A-Z over MAX_CAPITALS per cent of code points; D: any of SIGNS; E: the same text under a
smaller doc_id, wherever in the table and whether removed or not.

Defined cases: a null text is empty (it fails A, and E where a smaller doc_id is empty, too); a null source
is the part ''; a document without id is smaller than none and has none smaller, so it passes E; rows that
repeat count each, and equal ids don't fail E by one another; a document with several labels is good (toxic)
if any says so, one without labels is neither; shares at a limit pass; a very long text is one row like any
other, counted whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from derivia.llm.common import plain_keys, written
from derivia.llm.rules import SPACE_CHARS, WORD_SPLIT

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SIGNS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and whether A, B, C and D fail, for each row of docs(doc_id, text, source)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = plain_keys(docs, "doc_id", "text", "source").select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), t.alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT))
    less = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    d = d.select("doc_id", "part", F.sha2("t", 256).alias("digest"), F.length("t").alias("chars"), less(CAPITALS).alias("capitals"), less(SIGNS).alias("signs"), words.alias("words"))
    d = d.select("*", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    return d.select("doc_id", "part", "digest", (F.col("n") < MIN_WORDS).alias("A"), (100 * F.col("distinct") < MIN_DISTINCT * F.col("n")).alias("B"), (100 * F.col("capitals").cast("long") > MAX_CAPITALS * F.col("chars").cast("long")).alias("C"), (F.col("signs") > 0).alias("D"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (a bit for each filter, A the lowest), good and toxic for each row of docs. Both joins are by keys that only repeated rows share."""
    flags = written(text_flags(docs), "flags")
    first = flags.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = plain_keys(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows without an id have nothing to join with, and would all meet in one task
    known = flags.where("doc_id is not null").join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    unknown = flags.where("doc_id is null").select("*", F.lit(True).alias("first"), F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    both = known.unionByName(unknown).withColumn("E", F.col("first").isNull())
    failed = sum((F.col(f).cast("int") * 2**k for k, f in enumerate(FILTERS)), F.lit(0))
    return both.select("part", failed.alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """filter_order and the bits of its filters, s1 to s5, for each of the 120 orders."""
    rows = [("".join(p), *[2 ** FILTERS.index(f) for f in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, s1 int, s2 int, s3 int, s4 int, s5 int")


def replayed(rows: DataFrame) -> DataFrame:
    """The counts of every (part, filter_order, step) over rows(part, failed, good, toxic)."""
    steps = range(1, len(FILTERS) + 1)
    fails = lambda bit: F.col("failed").bitwiseAND(bit) != 0
    # 120 orders, whatever the documents: the one table that every document meets
    met = rows.crossJoin(F.broadcast(orders(rows.sparkSession)))
    first = F.coalesce(*[F.when(fails(F.col(f"s{k}")), F.lit(k)) for k in steps], F.lit(len(FILTERS) + 1))
    met = met.select("part", "filter_order", "failed", "good", "toxic", first.alias("first"), F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"s{k}").alias("bit")) for k in steps])).alias("at"))
    met = met.select("part", "filter_order", "failed", "good", "toxic", "first", F.col("at.step").alias("step"), F.col("at.bit").alias("bit"))
    here, now = F.col("first") == F.col("step"), F.col("first")
    when = {"kept": now > F.col("step"), "removed": here, "redundant": fails(F.col("bit")) & (now < F.col("step")), "unique_fails": F.col("failed") == F.col("bit"), "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic")}
    counts = met.groupBy("part", "filter_order", "step").agg(*[F.sum(when[k].cast("long")).alias(k) for k in SUMS])
    # 120 rows for each part and filter
    mine = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(mine))


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (a filter's removals summed over all orders), for docs(doc_id, text, source) and labels(doc_id, quality, toxic)."""
    return replayed(flagged(docs, labels))


def oracle() -> str:
    """The same in DuckDB SQL."""
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS lead FROM d),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
            CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[{SIGNS}]') THEN 'D' ELSE '' END
            || CASE WHEN lead < doc_id THEN 'E' ELSE '' END AS failed
          FROM w LEFT JOIN l USING (doc_id)),
    o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(string_split('{FILTERS}', '')) AS x) WHERE NOT contains(filter_order, x)),
    p AS (SELECT f.*, filter_order, step, filter_order[step] AS x, coalesce(list_min(list_filter(range(1, 6), lambda k: contains(failed, filter_order[k]))), 6) AS first
          FROM f, (SELECT filter_order FROM o WHERE length(filter_order) = 5), (SELECT unnest(range(1, 6)) AS step)),
    c AS (SELECT part, filter_order, CAST(step AS INT) AS step, any_value(x) AS x, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
            count(*) FILTER (WHERE contains(failed, x) AND first < step) AS redundant, count(*) FILTER (WHERE failed = x) AS unique_fails,
            count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost FROM p GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c"""
