"""Multi-party perspective rotation: a conversation once for each participant, who speaks as the assistant there.

A rendering is a string of turns `<|assistant|>\n...<|end|>\n` for the participant, `<|user name=X|>\n...`
for the others and `<|system|>\n...` for narrators, with the spans that the loss counts (the participant's
text and end mark). Long conversations come in parts of `part_turns` turns, so no task holds a
whole one: ranks within a conversation come from a range partitioning by (conversation, turn) and the counts
of the partitions before, and a conversation that has a third of all rows is spread like any other.

Defined cases: turns are ordered by turn, speaker and text, nulls first; a null text is empty, a null speaker is
'unknown'; rows of a null conversation are one conversation; repeated rows are turns of their own; a
conversation of narrators alone has one rendering with a null perspective and no span; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from derivia.llm.common import plain_keys, written

PART_TURNS = 64
NARRATORS = ("system",)
END = "<|end|>\n"


def ranked(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, speaker, text) plus rank, from 0 within each conversation."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "speaker", "text", "row"]
    placed = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("row"), "turns")
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # a conversation has a row here for each partition that it reaches into
    starts = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    joined = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    # rows of a partition are numbered without gaps
    return joined.select("conv_id", "turn", "speaker", "text", (F.col("before") + F.col("at") - F.col("first")).alias("rank"))


def rotated(conversations: DataFrame, part_turns: int = PART_TURNS, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, perspective, part, n_turns, text, mask ('start-end,...' in characters) for conversations(conv_id, turn, role, text)."""
    turns = plain_keys(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = written(ranked(turns), "ranked")
    people = turns.where(~F.col("speaker").isin(*narrators)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    parts = turns.groupBy("conv_id", F.floor(F.col("rank") / part_turns).cast("long").alias("part")).agg(F.sort_array(F.collect_list(F.struct("rank", "speaker", "text"))).alias("turns"))
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")), "left")

    def shown(t):
        name = F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"].isin(*narrators), t["speaker"]).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.struct((F.coalesce(t["speaker"] == F.col("perspective"), F.lit(False))).alias("own"), F.concat(F.lit("<|"), name, F.lit("|>\n")).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"))

    seen = seen.select("conv_id", "perspective", "part", F.transform("turns", shown).alias("s"))
    s = F.col("s")
    seen = seen.withColumn("text", F.array_join(F.transform(s, lambda x: F.concat(x["head"], x["body"])), ""))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(a, x):
        begin = a["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    mask = F.array_join(F.aggregate(s, none, add, lambda a: a["spans"]), ",")
    return seen.select("conv_id", "perspective", "part", F.size(s).cast("long").alias("n_turns"), "text", mask.alias("mask"))


def oracle(part_turns: int = PART_TURNS) -> str:
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS rank FROM t),
    people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
    s AS (SELECT r.conv_id, perspective, rank, CAST(rank // {part_turns} AS BIGINT) AS part, coalesce(speaker = perspective, false) AS own,
            '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN speaker ELSE 'user name=' || speaker END || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
          FROM r LEFT JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
    e AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY rank) AS BIGINT) AS stop FROM s)
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY rank) AS text,
           coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY rank) FILTER (WHERE own), '') AS mask
    FROM e GROUP BY conv_id, perspective, part"""
