"""Connected components of a link table, by alternating star contraction in DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm.common import Scratch, written


def is_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u > v) points at one other, which points nowhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): root is the smallest node that links reach. Nodes without links don't appear.

    Each round points every node at the smallest of its neighbourhood (first the larger neighbours,
    then the smaller ones), which halves distances; rounds stop when nothing but stars is left.
    Every round is written, so a lost executor repeats one round at most, and the round before it goes.
    Null ends are ignored; an empty table gives an empty one.
    """
    work = Scratch()
    edges = work.written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not is_stars(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, work.written(small, "edges")
        work.drop(before, large)
    out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct()), "roots")
    work.drop()
    return out
