"""Mixing sources to target weights with soft membership.

A softmax model on hashed text features, fitted on a bounded sample of a labelled table, predicts for each
document how likely it belongs to each domain. Nonnegative document rates are then fitted so that the
expected token totals of the domains match their targets: accelerated projected gradient on

    1/2 sum_k ((sum_d r_d n_d p_dk - target_k) / N)^2 + mu/2 sum_d n_d / N (r_d - 1)^2,   r >= 0

Every step is one Spark aggregation of as many numbers as there are domains; a document's rate follows
from its posteriors and the residuals of the steps before, so no rates travel or pile up anywhere.
Whole copies are drawn from a rate by the hash of the id.

Tokens are the ids of a tokenizer file where one is named, else white-space words.

Defined cases: null and empty texts have no tokens and rate 1; a domain without labelled rows has
posterior 0 and its target can't be met (it counts towards the residual alone); without any labels all
rates are those of equal posteriors; equal texts have equal posteriors and rates, and repeated rows of an
id equal copies; of tied labels of a document the first in alphabetical order counts; a very long text is
one document like any other, taken whole; an empty table gives an empty result; extra columns are
ignored; labels of null documents or domains are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from derivia.llm.common import Words, plain_keys, slices, small_batches, text_buffer, unused, written
from derivia.llm.linear import BITS, features, fit_on, probabilities
from derivia.llm.packing import encoder

#: Labelled rows of each domain that the classifier is fitted on, at most.
DOMAIN_ROWS = 4000
STEPS = 40
MU = 0.003


def replay(p: np.ndarray, residuals: list[np.ndarray], mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """The rates, and the point of the next gradient, after the steps whose residuals are given."""
    r = y = np.ones(len(p))
    t = 1.0
    for e in residuals:
        new = np.maximum(0.0, y - (p @ e + mu * (y - 1)) / (1 + mu))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        r, y, t = new, new + (t - 1) / after * (new - r), after
    return r, y


def domain_model(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and biases of the softmax model, fitted on at most DOMAIN_ROWS labelled documents of each domain; None without any.

    Of several rows of a labelled doc_id the one with the smallest text counts, so that the rows are bounded, too.
    """
    small_batches(docs.sparkSession)
    known = plain_keys(labels, "doc_id", "domain").where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = written(known.where(F.col("domain").isin(domains)).withColumn("h", F.xxhash64("doc_id")), "labels")
    share = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    if not share:
        return None
    picked = None
    for d in share:
        own = known.where(F.col("domain") == d).orderBy("h", "doc_id").limit(DOMAIN_ROWS).select("doc_id", "domain")
        picked = own if picked is None else picked.union(own)
    picked = written(picked, "sample")  # at most DOMAIN_ROWS ids of each domain
    target = F.array(*[(F.col("domain") == d).cast("double") for d in domains])
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    model = fit_on(rows.select("text", target.alias("target")), len(domains))
    if model is None:
        return None
    drawn = np.array([min(share.get(d, 0), DOMAIN_ROWS) for d in domains], float)
    real = np.array([share.get(d, 0) for d in domains], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return model[0], model[1] + np.where(real > 0, np.log(real / real.sum()) - np.log(drawn / drawn.sum()), -1e3)


def predicted(column: pa.Array, model: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """(texts, domains) posteriors."""
    if model is None:
        return np.full((len(column), k), 1 / k)
    return probabilities(*features(column, BITS), len(column), *model)


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and p (array, in the order of domains) for each row of docs(doc_id, text); labels(doc_id, domain). Tokens are ids of the tokenizer file, or words where none is given."""
    docs = plain_keys(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string"))
    return members_of(docs, domain_model(docs, labels, domains), len(domains), tokenizer)


def members_of(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, k: int, tokenizer: str | None) -> DataFrame:
    def predict(batches):
        for batch in slices(batches):
            column = batch.column("text")
            n = Words(column).per_row if tokenizer is None else np.array([len(x) for x in encoder(tokenizer)([t or "" for t in column.to_pylist()])], np.int64)
            p = pa.FixedSizeListArray.from_arrays(pa.array(predicted(column, model, k).ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), p], ["doc_id", "n_tokens", "p"])

    return docs.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, p array<double>")


def residuals_of(members: DataFrame, targets: list[float], budget: float | None, steps: int) -> list[np.ndarray]:
    """The residuals of the gradient steps over written members; as many numbers as domains in each."""
    k = len(targets)
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    goal = np.array(targets, float) / sum(targets) * ((budget or total) / max(total, 1))
    residuals: list[np.ndarray] = []

    def sums(batches):
        out = np.zeros(k)
        for batch in batches:
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            _, y = replay(p, residuals)
            out += (y * batch.column("n_tokens").to_numpy(zero_copy_only=False)) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(out)], ["k", "mass"])

    for _ in range(steps if total else 0):
        mass = {r["k"]: r["mass"] for r in members.select("n_tokens", "p").mapInArrow(sums, "k int, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect()}
        step = np.array([mass.get(i, 0.0) for i in range(k)]) / total - goal
        residuals.append(np.round(step, 12))
        if len(residuals) > 3 and np.abs(residuals[-1] - residuals[-2]).max() < 1e-6:
            break
    return residuals


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies for a rate: its fraction is drawn by the hash of the key (a null key has one hash, too)."""
    chance = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")


def rates(members: DataFrame, targets: list[float], budget: float | None = None, steps: int = STEPS) -> DataFrame:
    """members (doc_id, n_tokens, p) plus rate and copies; targets are the domains' weights, budget the tokens wanted in all (default: as many as there are)."""
    k = len(targets)
    members = written(members, "members")
    residuals = residuals_of(members, targets, budget, steps)

    def apply(batches):
        for batch in batches:
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rate = np.where(batch.column("n_tokens").to_numpy(zero_copy_only=False) > 0, replay(p, residuals)[0], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    kinds = dict(members.dtypes)
    out = members.select("doc_id", "n_tokens", "p").mapInArrow(apply, f"doc_id {kinds['doc_id']}, n_tokens long, p array<double>, rate double")
    return out.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, one p_<domain> each, rate and copies for every row of docs."""
    domains = list(targets)
    out = rates(posteriors(docs, labels, domains, tokenizer), list(targets.values()), budget)
    return out.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate", "copies")


def reached(mixed_rows: DataFrame, targets: dict[str, float]) -> DataFrame:
    """domain, wanted and reached shares of the expected tokens of a result of `mixed`."""
    mass = [F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in targets]
    one = mixed_rows.agg(F.array(*mass).alias("mass"))
    total = sum(targets.values())
    rows = F.explode(F.arrays_zip(F.array(*map(F.lit, targets)).alias("domain"), F.array(*[F.lit(w / total) for w in targets.values()]).alias("wanted"), F.col("mass")))
    return one.select(rows.alias("x"), F.aggregate("mass", F.lit(0.0), lambda a, x: a + x).alias("all")).select("x.domain", "x.wanted", (F.col("x.mass") / F.nullif("all", F.lit(0.0))).alias("reached"))


def label_domains(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as domains: toxic, low (not toxic, of low quality) and clean."""
    return plain_keys(labels, "doc_id", "quality", "toxic").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, tokenizer: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with every row as often as its rate draws it, with the same columns; rows without an id or a token stay once.

    Rates are told anew from the text as rows pass by, so no row is shuffled or written for it.
    """
    domains = list(targets)
    base = plain_keys(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string"))
    model = domain_model(base, labels, domains)
    members = written(members_of(base, model, len(domains), tokenizer), "members")
    residuals = residuals_of(members, list(targets.values()), budget, STEPS)
    name = unused(docs, "_rate")

    def apply(batches):
        for batch in slices(batches):
            column = batch.column("text")
            some = Words(column).per_row > 0 if tokenizer is None else np.diff(text_buffer(column)[1]) > 0
            rate = np.where(some, replay(predicted(column, model, len(domains)), residuals)[0], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, name])

    out = docs.mapInArrow(apply, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
    times = F.when(F.col("doc_id").isNull(), 1).otherwise(copies_of(F.col(name), F.col("doc_id")))
    return out.where(times > 0).withColumn(name, F.explode(F.array_repeat(F.lit(0), times))).drop(name)
