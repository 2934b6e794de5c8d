"""The engine's state: named DataFrames, each a base and the rows that changed since, under manifests that are the commits.

A transform writes the rows it changes, whatever the size of the table. What one reads is the base without
the keys that changed, and the latest rows of these. Small layers of changes are folded into larger ones,
so that there are few, and a base is written anew once the changes outgrow it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from derivia.plans.catalog import DEF_SCHEMA, Catalog

JOBS = "def_id long, row_key string, row_order string, source_hash string, status string, attempts int, next_attempt_at timestamp, claimed_by string, claimed_at timestamp, claimed_version int, last_error string, seq long, updated_at timestamp"
RESULTS = "def_id long, row_key string, version int, source_hash string, value string, confidence float, source string, is_current boolean, written boolean, model string, prompt_tokens double, completion_tokens double, cost decimal(38,12), latency_ms int, details string, seq long, created_at timestamp"
SPEND = "def_id long, day date, cost decimal(38,12), results long"
CELLS = "def_id long, row_key string, value string"
TABLES = {"jobs": JOBS, "results": RESULTS, "spend": SPEND, "cells": CELLS}
#: What tells the rows of a table apart; a change replaces the row with its key.
KEYS = {"jobs": ("def_id", "row_key", "seq"), "results": ("def_id", "row_key", "seq"), "spend": ("def_id", "day"), "cells": ("def_id", "row_key")}
#: Bases lie in folders by this column, so that claims don't read finished jobs, nor reads of what is current history.
FOLDERS = {"jobs": "status", "results": "is_current"}


def keys_of(name: str | tuple[str, ...]) -> tuple[str, ...]:
    """The key of a table of the state; of rows of a streamed table, which go by their key, that."""
    return KEYS[name] if isinstance(name, str) else name


#: Layers of changes that a table has at most.
MOST_LAYERS = 6
#: A base is written anew when the changes have so many times its rows.
REWRITE_AT = 2
#: Rows of a layer up to which its keys are sent to all tasks.
FEW_ROWS = 100_000


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Layer:
    """Rows that are written (n of them at most), and where in a store, if there."""

    rows: DataFrame
    n: int
    path: str | None = None


@dataclass(frozen=True)
class Layers:
    """A table: its base (of -1 rows while that is a plan) and the changes since, oldest first (rows with `_gone`)."""

    base: Layer
    changes: tuple[Layer, ...] = ()

    def read(self, name: str | tuple[str, ...]) -> DataFrame:
        out, columns = self.base.rows, self.base.rows.columns
        for c in self.changes:
            out = out.join(c_keys(name, c), [*keys_of(name)], "left_anti").select(*columns).union(c.rows.where("not _gone").select(*columns))
        return out

    def with_change(self, name: str | tuple[str, ...], change: Layer) -> Layers:
        """With one layer more, folded or with a new base as the sizes say."""
        if not change.n:
            return self
        if not self.base.n and not self.changes:
            return Layers(Layer(change.rows.where("not _gone").drop("_gone"), change.n))
        changes = [*self.changes, change]
        if self.base.n > 0 and sum(c.n for c in changes) > REWRITE_AT * self.base.n:
            return Layers(counted(Layers(self.base, tuple(changes)).read(name), name if isinstance(name, str) else "rows", FOLDERS.get(name)))
        if len(changes) > MOST_LAYERS:
            # the last layers as long as the one before isn't much larger than they together; two at least
            k, total = len(changes) - 2, changes[-1].n + changes[-2].n
            while k and changes[k - 1].n <= 2 * total:
                k -= 1
                total += changes[k].n
            changes[k:] = [folded(name, changes[k:])]
        return Layers(self.base, tuple(changes))


def c_keys(name: str | tuple[str, ...], layer: Layer) -> DataFrame:
    keys = layer.rows.select(*keys_of(name))
    return F.broadcast(keys) if layer.n <= FEW_ROWS else keys


def folded(name: str | tuple[str, ...], layers: list[Layer]) -> Layer:
    """Several layers as one; what is gone stays told."""
    out = layers[0].rows
    for c in layers[1:]:
        out = out.join(c_keys(name, c), [*keys_of(name)], "left_anti").select(*out.columns).union(c.rows.select(*out.columns))
    return counted(out, name if isinstance(name, str) else "rows")


@dataclass(frozen=True)
class Streamed:
    """The rows of a streamed table: its key, base and changes, the micro-batch (its stream and number) that they end with, and what is known of each key ever seen."""

    pk: tuple[str, ...]
    layers: Layers
    upto: tuple[str, int]
    known: Layers | None = None

    def read(self) -> DataFrame:
        return self.layers.read(self.pk)


@dataclass(frozen=True)
class State:
    """jobs: live and finished work; results: every value ever, with what is current; spend: cost by UTC day; cells: what the columns hold; streams: the last rows of streamed tables."""

    catalog: Catalog
    jobs: DataFrame
    results: DataFrame
    spend: DataFrame
    cells: DataFrame
    seq: int = 0
    streams: dict[str, Streamed] = field(default_factory=dict)
    #: base and changes of the tables that are written as such; the others are plans
    layers: dict[str, Layers] = field(default_factory=dict)

    @staticmethod
    def empty(spark: SparkSession) -> State:
        tables = {k: spark.createDataFrame([], s) for k, s in TABLES.items()}
        return State(Catalog(), *tables.values(), layers={k: Layers(Layer(v, 0)) for k, v in tables.items()})

    def defs(self) -> DataFrame:
        """The definitions as rows; there are as many as declarations, not as data."""
        return self.jobs.sparkSession.createDataFrame(self.catalog.rows(), DEF_SCHEMA)

    def put(self, **changed) -> State:
        """With other tables, cast to their schemas, one sequence number on."""
        cast = {k: conform(v, TABLES[k]) if k in TABLES else v for k, v in changed.items()}
        return replace(self, seq=self.seq + 1, layers={k: v for k, v in self.layers.items() if k not in changed}, **cast)

    def changed(self, at_most: dict[str, int] | None = None, **rows: DataFrame) -> State:
        """With these rows in place of those with their keys (`_gone`: without them), one sequence number on.

        The rows are written now, but for tables in at_most: their rows are read from what is written
        already, and are so many at most.
        """
        tables, layers = {}, dict(self.layers)
        for name, df in rows.items():
            df = conform(df, TABLES[name] + ", _gone boolean").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
            change = counted(df, name) if at_most is None or name not in at_most else Layer(df, at_most[name])
            if change.n:
                # a table that is a plan yet stays one below the change
                old = layers.get(name)
                layers[name] = Layers(Layer(getattr(self, name), -1), (change,)) if old is None else old.with_change(name, change)
                tables[name] = layers[name].read(name)
        return replace(self, seq=self.seq + 1, layers=layers, **tables)

    def materialized(self, *names: str) -> State:
        """With the tables (all by default) written, so that plans end there and models aren't called again; what is written already is left as it is."""
        tables, layers = {}, dict(self.layers)
        for name in names or TABLES:
            if name not in layers or layers[name].base.n < 0:
                layers[name] = Layers(counted(getattr(self, name), name, FOLDERS.get(name)))
                tables[name] = layers[name].read(name)
        return replace(self, layers=layers, **tables)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema in its types, absent ones as nulls."""
    parts = [p.strip().split(" ", 1) for p in schema.replace("decimal(38,12)", "decimal(38;12)").split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in parts])


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder. On a local master that has none we set our own; elsewhere that would be a folder of one machine, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def materialized(df: DataFrame, name: str) -> DataFrame:
    return counted(df, name).rows


def counted(df: DataFrame, name: str, folders: str | None = None, path: str | None = None) -> Layer:
    """df written, in folders by a column if one is given, with the number of its rows."""
    place = path or f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    write = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    (write.partitionBy(folders) if folders else write).parquet(place)
    return Layer(df.sparkSession.read.schema(df.schema).parquet(place).select(*df.columns), seen.get["n"], path)


def published(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file `path` with this content, whole or not at all; False if there is one already.

    The content is written under another name and then renamed, which fails where the name is taken: one
    step of the file system on HDFS. A writer that dies leaves a file that nobody looks at.
    """
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(sc._jsc.hadoopConfiguration())
    target = files.makeQualified(target)
    draft = hadoop.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder without drafts; none where it doesn't exist."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return [x for x in names if not x.startswith(("_", "."))]


def deleted_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


class Store:
    """Committed states under a path. A commit writes the layers that its parent hasn't and then publishes manifest N + 1, which names all; whoever does so first wins, and a writer that dies before has changed nothing.

    Of old versions the last `keep` stay readable: what only older ones name is deleted with a commit.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def head(self) -> int:
        return max((int(x) for x in listed(self.spark, f"{self.path}/manifests") if x.isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}", wholetext=True).first()["value"])

    def stored(self, layer: Layer, name: str, folders: str | None = None) -> dict:
        """The layer as its manifest tells it; written unless it lies here already."""
        if layer.path is None or not layer.path.startswith(f"{self.path}/"):
            layer = counted(layer.rows, name, folders, f"{self.path}/{name}/{uuid.uuid4().hex}")
        return {"path": layer.path.removeprefix(f"{self.path}/"), "n": layer.n}

    def commit(self, state: State, parent: int) -> int:
        """Store the state as the successor of `parent`; Conflict if that has one already. Streamed tables that the parent names stay named."""
        tables = {}
        for name in TABLES:
            own = state.layers.get(name)
            if own is None or own.base.n < 0:
                own = Layers(Layer(getattr(state, name), -1))
            tables[name] = {"base": self.stored(own.base, name, FOLDERS.get(name)), "changes": [self.stored(c, name) for c in own.changes]}
        kept = self.manifest(parent)["streams"] if parent else {}
        for name, t in state.streams.items():
            told = lambda layers, folder: {"schema": layers.base.rows.schema.jsonValue(), "base": self.stored(layers.base, folder), "changes": [self.stored(c, folder) for c in layers.changes]}
            kept[name] = {"pk": t.pk, "upto": t.upto} | told(t.layers, f"rows/{name}") | ({} if t.known is None else {"known": told(t.known, f"known/{name}")})
        if not published(self.spark, f"{self.path}/manifests/{parent + 1}", json.dumps({"tables": tables, "seq": state.seq, "catalog": state.catalog.to_json(), "streams": kept})):
            raise Conflict(f"manifest {parent + 1} exists")
        self.expire(parent + 1)
        return parent + 1

    def expire(self, head: int) -> None:
        """Delete the version that a new head makes too old, and what no later one names."""
        old = head - self.keep
        if old < 1 or str(old) not in listed(self.spark, f"{self.path}/manifests"):
            return
        streamed = lambda m: [x for t in m["streams"].values() for x in (t, t.get("known")) if x]
        names = lambda m: {x["path"] for t in (*m["tables"].values(), *streamed(m)) for x in (t["base"], *t["changes"])}
        gone = names(self.manifest(old)) - names(self.manifest(old + 1))
        for path in gone:
            deleted_path(self.spark, f"{self.path}/{path}")
        deleted_path(self.spark, f"{self.path}/manifests/{old}")

    def load(self, version: int | None = None) -> State:
        version = version or self.head()
        if not version:
            return State.empty(self.spark)
        m, layers, streams = self.manifest(version), {}, {}
        place = lambda x: f"{self.path}/{x['path']}"
        for name, t in m["tables"].items():
            read = lambda x, schema: Layer(conform(self.spark.read.schema(schema).parquet(place(x)), schema), x["n"], place(x))
            layers[name] = Layers(read(t["base"], TABLES[name]), tuple(read(c, TABLES[name] + ", _gone boolean") for c in t["changes"]))
        for name, t in m["streams"].items():
            rows = lambda x, schema: Layer(self.spark.read.schema(schema).parquet(place(x)), x["n"], place(x))

            def read_all(t: dict) -> Layers:
                fields = StructType.fromJson(t["schema"])
                marked = StructType([*fields.fields, StructField("_gone", BooleanType())])
                return Layers(rows(t["base"], fields), tuple(rows(c, marked) for c in t["changes"]))  # noqa: B023

            streams[name] = Streamed(tuple(t["pk"]), read_all(t), tuple(t["upto"]), read_all(t["known"]) if "known" in t else None)
        return State(Catalog.from_json(m["catalog"]), *(layers[n].read(n) for n in TABLES), seq=m["seq"], streams=streams, layers=layers)

    def transact(self, step, attempts: int = 20):
        """step(state) -> (state, result) on the newest state, committed; on a lost race again on what won, so that two claimers get different jobs and both commit. A step that changes nothing commits nothing. Returns the result."""
        for _ in range(attempts):
            head = self.head()
            before = self.load(head)
            state, result = step(before)
            if head and (state.catalog, state.layers, state.streams) == (before.catalog, before.layers, before.streams):
                return result
            try:
                self.commit(state, head)
            except Conflict:
                continue
            return result
        raise Conflict(f"lost {attempts} races")
