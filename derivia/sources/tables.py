"""Sources and sinks: the built-in readers and writers, with schemas given rather than inferred where they can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READERS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true"}, "text": {}}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of files; json reads lines, compressed or not. csv and json want a schema at scale, as inference reads everything."""
    if kind not in READERS:
        raise ValueError(f"unknown kind: {kind}")
    reader = spark.read.format(kind).options(**READERS[kind] | options)
    return (reader.schema(schema) if schema else reader).load(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read(spark, f"{folder}/{name}.parquet")


def database(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table over JDBC (the driver's jar must be there); partition is (column, from, to, tasks)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        reader = reader.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
    return reader.load()


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**(READERS.get(kind, {}) | options))
    (writer.partitionBy(*by) if by else writer).save(path)
