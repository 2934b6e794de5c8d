"""Runs providers over claimed jobs: Arrow batches on the executors, one call for a row, for several questions on a row, or for several texts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.functions import keys, replies
from derivia.functions.providers import Answer, Provider, classify, priced
from derivia.operators.contract import COMPUTED
from derivia.plans.catalog import Definition
from derivia.plans.state import State, materialized

COLUMNS = [p.strip().split(" ")[0] for p in COMPUTED.split(",")]
ARROW = {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
FIELDS = pa.schema([(c, ARROW[t]) for c, t in (p.strip().split(" ") for p in COMPUTED.split(","))])
#: Questions in one decision call at most.
FAN_OUT = 16
as_json = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def row_of(job: dict, a: Answer, config: dict) -> tuple:
    u = priced(a.usage, config)
    value = None if a.error is not None else as_json(a.value)
    return (job["def_id"], job["row_key"], job["source_hash"], value, a.confidence, a.model, u.get("prompt_tokens"), u.get("completion_tokens"), u.get("cost"), a.latency_ms, None if a.details is None else json.dumps(a.details), a.error, a.retryable, a.rate_limited)


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    """frame as Arrow; NaN is null as there."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, FIELDS, strict=True)], schema=FIELDS)


def tried(call, n: int) -> list[Answer]:
    """The answers of a call for n jobs; an exception or a wrong number of answers fails them all, as data."""
    try:
        out = call()
    except Exception as e:
        return [classify(e)] * n
    return out if len(out) == n else [Answer(error="wrong number of answers", retryable=True)] * n


def settings(d: Definition) -> dict:
    v = d.current
    return {"prompt": v.prompt, "schema": v.schema, "output_type": d.output_type, "model": v.model, "config": d.config, "backend_config": v.backend_config}


def derived(jobs: DataFrame, d: Definition, provider: Provider) -> DataFrame:
    """A call for each row, as many at once in a task as the column's concurrency says.

    A provider with `reply` gets the whole message and the schema of the reply, and gives the model's text as
    value; that is parsed and checked against the schema in the JVM, and a wrong one is an error that may be tried again.
    """
    s = settings(d)
    raw = hasattr(provider, "reply")
    if raw:
        s |= {"response_schema": replies.response_schema(d.output_type, d.current.schema)}
        jobs = jobs.withColumn("message", keys.user_message(d.current.prompt or "", d.current.schema, F.coalesce("text", F.lit(""))))
    ask = provider.reply if raw else provider.derive

    def one(x: dict) -> tuple:
        try:
            a = ask(s | x)
        except Exception as e:
            a = classify(e)
        return row_of(x, a, s["config"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threads = max(1, int(s["config"]["concurrency"]))
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                todo = batch.to_pylist()
                # a thread takes some rows at a time, but leaves enough for the others
                part = max(1, min(32, len(todo) // (4 * threads)))
                parts = pool.map(lambda k: [one(x) for x in todo[k : k + part]], range(0, len(todo), part))  # noqa: B023
                yield record_batch([r for p in parts for r in p])

    out = jobs.mapInArrow(run, COMPUTED)
    return checked_replies(out, d) if raw else out


def checked_replies(answers: DataFrame, d: Definition) -> DataFrame:
    """Answers whose value is a reply's text, with the value and confidence that it holds, or with what is wrong with it; what they cost stays."""
    text = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]
    got = answers.withColumn("_reply", F.when(F.col("error").isNull(), replies.checked(d.output_type, d.current.schema, text)))
    wrong = F.col("_reply.error").isNotNull()
    new = {"value": F.col("_reply.value"), "confidence": F.col("_reply.confidence").cast("float"), "error": F.coalesce("error", "_reply.error"), "retryable": wrong | F.col("retryable")}
    return got.withColumns(new).select(*COLUMNS)


def embedded(jobs: DataFrame, d: Definition, provider: Provider) -> DataFrame:
    """A call for every batch_size texts of a task (100 where backend_config has none)."""
    s = settings(d)
    size = int(s["backend_config"].get("batch_size", 100))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (x for batch in batches for x in batch.to_dict("records"))
        while part := list(islice(every, size)):
            answers = tried(lambda: provider.embed(s["model"], [x["text"] or "" for x in part], s["backend_config"]), len(part))  # noqa: B023
            yield frame([row_of(x, a, s["config"]) for x, a in zip(part, answers, strict=True)])

    return jobs.mapInPandas(run, COMPUTED)


def fanned_out(jobs: DataFrame, defs: list[Definition]) -> DataFrame:
    """The questions of each (row, sources, model) in calls of at most FAN_OUT: row_key, model, call, jobs. A row has as many as there are definitions."""
    models = F.create_map(*[F.lit(x) for d in defs for x in (d.def_id, d.current.model)])
    packed = jobs.withColumn("model", models[F.col("def_id")]).groupBy("row_key", "text", "model").agg(F.array_sort(F.collect_list(F.struct("def_id", "source_hash"))).alias("all"))
    calls = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / FAN_OUT).cast("int")), lambda i: F.slice(F.col("all"), i * FAN_OUT + 1, FAN_OUT))
    return packed.select("row_key", "text", "model", F.posexplode(calls).alias("call", "jobs"))


def decisions(jobs: DataFrame, defs: list[Definition], provider: Provider) -> DataFrame:
    """A call for the questions of several columns on one row. A missing answer fails its own job only."""
    every = {d.def_id: settings(d) for d in defs}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.to_dict("records"):
                todo = [every[q["def_id"]] | {"def_id": q["def_id"], "row_key": x["row_key"], "text": x["text"], "source_hash": q["source_hash"]} for q in x["jobs"]]
                rows += [row_of(j, a, j["config"]) for j, a in zip(todo, tried(lambda: provider.decide(todo), len(todo)), strict=True)]  # noqa: B023
            yield frame(rows)

    return fanned_out(jobs, defs).mapInPandas(run, COMPUTED)


def computed(state: State, claimed: DataFrame, provider: Provider) -> DataFrame:
    """All claimed jobs computed once and written: what follows reads that, and no model is called again."""
    out = None
    for backend in ("llm", "custom", "embedding", "decision"):
        defs = [d for d in state.catalog.defs if d.current.backend == backend and not d.deleted]
        if not defs:
            continue
        mine = lambda d: claimed.where(F.col("def_id") == d.def_id).select("def_id", "row_key", "source_hash", "text")
        if backend == "decision":
            parts = [decisions(claimed.where(F.col("def_id").isin([d.def_id for d in defs])), defs, provider)]
        else:
            parts = [(embedded if backend == "embedding" else derived)(mine(d), d, provider) for d in defs]
        for p in parts:
            out = p if out is None else out.union(p)
    return materialized(claimed.sparkSession.createDataFrame([], COMPUTED) if out is None else out, "computed")
