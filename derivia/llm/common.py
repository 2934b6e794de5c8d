"""Shared pieces: the folder all executors see, and vectorised hashing of words in Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivia.plans.state import work_folder

U64 = np.uint64
#: Text bytes that one numpy step handles, so that its arrays stay near 50 MB.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch of texts, where the session hasn't set a number of its own.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python tasks in batches of BATCH_ROWS rows, if the session has Spark's default number (10,000 rows of long texts take a good part of an executor)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once into the shared folder and read back, so that later steps neither repeat it nor depend on its executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written steps of a job that go once what follows them is written."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(df.sparkSession, name)
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *steps: DataFrame) -> None:
        """Delete the files of the steps (of all that are left, if none are named); what isn't from here stays."""
        for key in [id(x) for x in steps] if steps else list(self.paths):
            df, path = self.paths.pop(key, (None, None))
            if path:
                delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fits_broadcast(df: DataFrame, limit_rows: int) -> bool:
    """Whether df has at most limit_rows rows; reads no more than it must to tell."""
    return df.limit(limit_rows + 1).count() <= limit_rows


# --- words of Arrow text columns, without a Python object per word ----------------------------------

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_KEY = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
PLACE_KEY = mix(np.arange(1, 65, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
#: What a byte adds to a word's hash, by its place.
PLACED = BYTE_KEY * PLACE_KEY[:, None]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the len + 1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES):
    """The rows of the batches again, in slices of about limit text bytes (a longer text comes alone)."""
    for batch in batches:
        column = batch.column(text)
        _, offsets = text_buffer(column)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del batch, column, offsets
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


class Words:
    """The words of a text column: bytes, start and end of each word, and the row it is in."""

    def __init__(self, column: pa.Array, lower: bool = False, apart: np.ndarray = SPACE):
        """apart: the bytes that stand between words."""
        self.data, self.rows = text_buffer(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~apart[self.data]
        first = np.zeros(n + 1, bool)
        first[self.rows] = True  # a row's first byte, and the end
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.starts = np.flatnonzero(inside & (~before | first[:n]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.row = np.searchsorted(self.rows, self.starts, "right") - 1
        # a row's empty predecessors share its offset; the rightmost one holds the word
        self.per_row = np.bincount(self.row, minlength=len(self.rows) - 1) if len(self.rows) > 1 else np.zeros(0, np.int64)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, U64)
        lengths = self.ends - self.starts
        near = np.minimum(lengths, len(PLACE_KEY))
        order = np.argsort((len(PLACE_KEY) - near).astype(np.uint8), kind="stable")  # long words first
        at = self.starts[order]
        longer = len(at) - np.cumsum(np.bincount(near, minlength=len(PLACE_KEY) + 1))
        total = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for place, n in enumerate(longer[:-1]):  # one byte of the words that have it at a time: arrays are by words, not by bytes
                if not n:
                    break
                total[:n] += PLACED[place].take(self.data[place:].take(at[:n]))
            total[order] = total.copy()
            far = np.flatnonzero(lengths > len(PLACE_KEY))
            if len(far):
                count = lengths[far] - len(PLACE_KEY)
                begin = np.cumsum(count) - count
                place = np.arange(count.sum()) - np.repeat(begin, count) + len(PLACE_KEY)
                key = mix(place.astype(U64) * U64(0xD1B54A32D192ED03)) | U64(1)
                total[far] += np.add.reduceat(BYTE_KEY[self.data[np.repeat(self.starts[far], count) + place]] * key, begin)
            return mix(total ^ (lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `size` words of a row; of a row with fewer words, the whole run as one."""
    h, row = words.hashes(), words.row
    n = len(h)
    if not n:
        return h, row
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, n - size + 1), U64)
        for k in range(size):
            full = full * U64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k] if len(full) else full
        same = row[: len(full)] == row[size - 1 :] if len(full) else np.zeros(0, bool)
        out, at = [mix(full[same])], [row[: len(full)][same]]
        short = np.flatnonzero((words.per_row > 0) & (words.per_row < size))
        if len(short):
            begin = np.searchsorted(row, short)
            count = words.per_row[short]
            run = np.zeros(len(short), U64)
            for k in range(size - 1):
                has = k < count
                run = np.where(has, run * U64(0x9E3779B97F4A7C15) + h[np.minimum(begin + k, n - 1)], run)
            out.append(mix(run ^ mix(count.astype(U64) + U64(77))))
            at.append(short)
    return np.concatenate(out), np.concatenate(at)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists with the given counts over a flat array."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def plain_keys(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, absent ones as nulls, so that extra columns of a table can't clash with ours."""
    return df.select(*[F.col(f"`{x}`") if x in df.columns else F.lit(None).alias(x) for x in names])
