"""The corpus pipeline: documents through the operators, stage by stage.

Each stage takes what the one before kept, written as Parquet and read again; all but the last return the
columns of documents. A lost executor costs tasks of one stage; a stage's files go once the next stage is
written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from derivia.llm import jaccard, mixing, packing, quality, rules
from derivia.llm.common import Scratch, table
from derivia.llm.registry import tokenizer_path

#: Weights of the domains after mixing; good text is what the stages before leave most of.
MIX = {"clean": 0.95, "toxic": 0.05}
MAX_TOKENS = 1024


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go."""
    return rules.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by rates that bring the domains to their weights."""
    return mixing.drawn(docs, mixing.label_domains(table(spark, sf_dir, "labels")), MIX, tokenizer=tokenizer_path())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in sequences of at most MAX_TOKENS."""
    return packing.pack_documents(docs, tokenizer_path(), MAX_TOKENS)


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("near_duplicates", deduplicate), ("mixing", mix), ("packing", pack)]

#: EM, a fitted model and tokenisation can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, work = table(spark, sf_dir, "documents"), Scratch()
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.written(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
