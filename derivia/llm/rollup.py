"""Token counts as delta-maintained rollups.

A batch of changes becomes signed rows (source, lang, tokenizer, docs, tokens): an insert adds, a delete
takes away, a revision takes the old count away and adds the new one. Spark sums them by key before
anything is stored, so a commit has one row for each key that changed. A commit is a data folder and
then a marker named after the batch, which appears whole under its name or not at all: whoever makes it
has committed, a batch that comes again changes nothing, and data without a marker is never read. Totals
are the sums over committed batches; `compact` folds them into one by a marker of the same kind.

Defined cases: null sources and languages are keys of their own; null counts add no tokens; repeated rows
of a batch are changes of their own; a null or unknown op fails its batch, and nothing of it counts; keys
whose totals are all zero are left out; an empty batch commits and adds nothing; an empty table gives
empty totals; a null text has no token, a very long one is counted whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.llm.common import Words, plain_keys, slices, small_batches, written
from derivia.llm.packing import encoder
from derivia.plans.state import listed, published

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
WORD = "[^\\x20\\x09-\\x0D]+"
#: A word with an ASCII letter or digit, or anything beyond ASCII.
LETTERED = "[^\\x20\\x09-\\x0D]*[0-9A-Za-z\\x{80}-\\x{10FFFF}][^\\x20\\x09-\\x0D]*"


def signed(changes: DataFrame) -> DataFrame:
    """changes(op, source, lang, tokenizer, tokens, old_tokens) to summed signed rows, and how many have no known op (insert, delete or revise)."""
    c = plain_keys(changes, "op", *KEYS, "tokens", "old_tokens")
    op = F.coalesce(F.col("op").cast("string"), F.lit(""))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    new, old = (F.coalesce(F.col(x).cast("long"), F.lit(0).cast("long")) for x in ("tokens", "old_tokens"))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(0)
    rows = c.select(*[F.col(k).cast("string").alias(k) for k in KEYS], docs.alias("docs"), tokens.cast("long").alias("tokens"), (~op.isin("insert", "delete", "revise")).cast("long").alias("unknown"))
    return rows.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in ("docs", "tokens", "unknown")])


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors see.

    batches/<name> says in which data folder a batch's sums are. compactions/<n> names a data folder that
    has the sums of many batches, and covered/<the same name> lists them; the newest counts. Both kinds
    of file appear whole or not at all, and nothing that they name is ever changed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self, batch: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{batch}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply the batch once; False if it had been committed before. ValueError, and nothing applied, where a change has no known op."""
        if not re.fullmatch(r"\w[\w.-]*", batch, re.ASCII) or batch.startswith("_"):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        data = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.path}/data/{data}")
        unknown = self.spark.read.parquet(f"{self.path}/data/{data}").agg(F.sum("unknown")).first()[0]
        if unknown:
            raise ValueError(f"{unknown} changes have an op other than insert, delete or revise")
        return published(self.spark, f"{self.path}/batches/{batch}", data)

    def _compacted(self) -> tuple[int, str | None]:
        """Number and data folder of the newest compaction."""
        last = max((int(x) for x in listed(self.spark, f"{self.path}/compactions")), default=0)
        return last, self.spark.read.text(f"{self.path}/compactions/{last}").first()["value"] if last else None

    def _batches(self, compacted: str | None) -> DataFrame:
        """(batch, data) of the batches that the compaction doesn't have."""
        if not listed(self.spark, f"{self.path}/batches"):
            return self.spark.createDataFrame([], "batch string, data string")
        rows = self.spark.read.text(f"{self.path}/batches").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("batch"), F.col("value").alias("data"))
        return rows.join(self.spark.read.parquet(f"{self.path}/covered/{compacted}"), "batch", "left_anti") if compacted else rows

    def _sums(self, compacted: str | None, batches: DataFrame) -> DataFrame:
        folders = [compacted] * bool(compacted) + [r["data"] for r in batches.select("data").collect()]  # one for each batch since the last compaction
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        stored = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/data/{x}" for x in folders])
        return stored.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        _, compacted = self._compacted()
        return self._sums(compacted, self._batches(compacted))

    def compact(self) -> bool:
        """Fold what is committed into one data folder: one more file, after which totals read that. False if another compaction came first.

        Batches stay known, and those committed meanwhile are added to the folded ones. A run that dies
        leaves the totals as they are.
        """
        last, compacted = self._compacted()
        fresh, data = self._batches(compacted), uuid.uuid4().hex
        rows = self.spark.createDataFrame(fresh.collect(), fresh.schema)  # fixed now: what comes later isn't folded
        self._sums(compacted, rows).write.parquet(f"{self.path}/data/{data}")
        known = rows.select("batch")
        (known.union(self.spark.read.parquet(f"{self.path}/covered/{compacted}")) if compacted else known).write.parquet(f"{self.path}/covered/{data}")
        return published(self.spark, f"{self.path}/compactions/{last + 1}", data)


@lru_cache(maxsize=4)
def id_counter(path: str):
    """texts -> numbers of ids by the tokenizer file at path: a tokenizers file (.json) or a sentencepiece model (.model)."""
    if path.endswith(".model"):
        import sentencepiece

        encode = partial(sentencepiece.SentencePieceProcessor(model_file=path).encode, num_threads=1)
    else:
        encode = encoder(path)
    return lambda texts: [len(ids) for ids in encode(texts)]


def token_counts(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """source, lang, n_words and n (map of tokenizer version to number of ids) of each row of docs(text, source, lang); every whole text is encoded by every tokenizer, once."""
    small_batches(docs.sparkSession)
    base = plain_keys(docs, "text", "source", "lang").select(*[F.col(c).cast("string") for c in ("text", "source", "lang")])

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns = [batch.column("source"), batch.column("lang"), pa.array(Words(batch.column("text")).per_row, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(id_counter(path)(texts), pa.int64()) for path in tokenizers.values()], ["source", "lang", "n_words", *(f"n{i}" for i in range(len(tokenizers)))])

    counts = base.mapInArrow(run, "source string, lang string, n_words long" + "".join(f", n{i} long" for i in range(len(tokenizers))))
    return counts.select("source", "lang", "n_words", F.create_map(*[x for i, t in enumerate(tokenizers) for x in (F.lit(t), F.col(f"n{i}"))]).alias("n"))


def delivered(per: DataFrame, few: Column, revised: DataFrame, path: str) -> DataFrame:
    """Totals after four deliveries of rows (source, lang, n: map of tokenizer version to tokens): all are inserted; the few are deleted; counts are revised; the deletes come a second time."""
    change = lambda rows, op: rows.select(F.lit(op).alias("op"), "source", "lang", F.explode("n").alias("tokenizer", "tokens"))
    rollup = Rollup(per.sparkSession, path)
    rollup.commit("inserts-1", change(per, "insert"))
    rollup.commit("deletes-1", change(per.where(few), "delete"))
    rollup.commit("recount-1", revised)
    rollup.commit("deletes-1", change(per.where(few), "delete"))
    return rollup.totals()


def document_rollup(docs: DataFrame, tokenizers: dict[str, str], path: str) -> DataFrame:
    """Token totals of the documents by source, language and tokenizer version (a name and its file): all are inserted, those of under 20 words are deleted, and the first version's counts are revised to have the end id of each document, too."""
    per = written(token_counts(docs, tokenizers), "counts")
    few: Column = F.col("n_words") < 20
    first = F.lit(next(iter(tokenizers)))
    return delivered(per, few, per.where(~few).select(F.lit("revise").alias("op"), "source", "lang", first.alias("tokenizer"), (F.col("n")[first] + 1).alias("tokens"), F.col("n")[first].alias("old_tokens")), path)


def word_rollup(docs: DataFrame, path: str) -> DataFrame:
    """The same deliveries with counts that SQL can tell: words (then revised to words with a letter or digit) and bytes."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = plain_keys(docs, "text", "source", "lang").select("source", "lang", t.alias("text"))
    count = lambda rule: F.regexp_count("text", F.lit(rule)).cast("long")
    per = written(base.select("source", "lang", count(LETTERED).alias("n_lettered"), F.create_map(F.lit("words-1"), count(WORD), F.lit("bytes-1"), F.octet_length("text").cast("long")).alias("n")), "counts")
    words = F.col("n")["words-1"]
    return delivered(per, words < 20, per.where((words >= 20) & (words != F.col("n_lettered"))).select(F.lit("revise").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("n_lettered").alias("tokens"), words.alias("old_tokens")), path)


def oracle() -> str:
    """SQL of `word_rollup`."""
    return r"""
    WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents),
    n AS (SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, len(regexp_extract_all(t, '[^\x20\x09-\x0D]*[0-9A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*')) AS l, strlen(t) AS b FROM d),
    k AS (SELECT * FROM n WHERE w >= 20)
    SELECT source, lang, 'words-1' AS tokenizer, count(*) AS docs, CAST(sum(l) AS BIGINT) AS tokens FROM k GROUP BY ALL
    UNION ALL
    SELECT source, lang, 'bytes-1' AS tokenizer, count(*) AS docs, CAST(sum(b) AS BIGINT) AS tokens FROM k GROUP BY ALL"""
