"""Mixing documents to target weights by soft membership.

A classifier fitted on labelled rows gives each document's posterior over
domains. Nonnegative rates r, one a document, are fitted by least squares so
that the expected tokens of each domain, the sum of r * tokens * posterior, match
their targets. From r = 1, each step moves against the gradient and cuts at 0:
with the moments M (the sum of tokens * posterior * posterior') as the measure
of misses and tokens as that of rates, the Lipschitz constant is one, so a step
of one never overshoots; accelerated steps (with momentum, dropped whenever the
miss rises) need few passes. All that goes to the driver is one small sum over
domains a step, and all that comes back is one direction. A rate is a function of the posterior and the steps so far, so no
step rewrites the table.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .scratch import Scratch

FEATURES = 1 << 16
#: Labelled rows the classifier is fitted on; the driver holds their hashed words.
SAMPLE = 8_000
EPOCHS, RATE, DECAY = 120, 0.5, 1e-3
#: A word counts if some domain has it this many standard deviations more or less often than by chance.
TELLING = 5.0
#: Steps at most, and the miss of a target, as a share of all tokens, that is small enough. What is missed in the end is reported.
STEPS, ENOUGH = 30, 1e-4


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row: toxic, else by quality; null if a label is missing."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "high").when((toxic == 0) & (quality == 0), "low")


def _words(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, words of each text, first feature of each text, distinct features of the texts)."""
    for part, offsets, data in W.chunks(batch):
        w = W.words(offsets, data)
        sizes = np.diff(w.first)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        key = np.unique(doc * FEATURES + (w.hash % np.uint64(FEATURES)).astype(np.int64))
        yield part, sizes, np.searchsorted(key // FEATURES, np.arange(len(sizes) + 1)), key % FEATURES


def _sample(labels: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array(sorted(labels), np.int64)
        for batch in batches:
            own = batch.filter(pa.array(np.isin(batch.column("id").to_numpy(zero_copy_only=False), ids)))
            for part, _, first, features in _words(own):
                got = part.column("id").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([labels[i] for i in got]), pa.array([features[a:b].tolist() for a, b in zip(first, first[1:])], pa.list_(pa.int32()))], names=["id", "domain", "features"])

    return run


class Classifier:
    """Softmax regression on the presence of hashed words."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posterior(self, first: np.ndarray, features: np.ndarray) -> np.ndarray:
        z = np.tile(self.bias, (len(first) - 1, 1))
        full = np.diff(first) > 0
        if full.any():
            z[full] += np.add.reduceat(self.weights[features], first[:-1][full], axis=0)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(first: np.ndarray, features: np.ndarray, domains: list[str]) -> Classifier:
    names = sorted(set(domains))
    y = np.array([names.index(d) for d in domains])
    want = np.eye(len(names))[y]
    model = Classifier(names, np.zeros((FEATURES, len(names))), np.log(want.mean(axis=0) + 1e-9))
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    seen = np.stack([np.bincount(features, want[doc, k], minlength=FEATURES) for k in range(len(names))], axis=1)
    chance = seen.sum(axis=1, keepdims=True) * want.mean(axis=0)
    telling = (np.abs(seen - chance) >= TELLING * np.sqrt(chance + 1)).any(axis=1)
    own = telling[features]
    first, features, doc = np.concatenate([[0], np.cumsum(own)])[first], features[own], doc[own]
    square = np.full(FEATURES, 1e-8)
    for _ in range(EPOCHS):
        off = (model.posterior(first, features) - want) / len(y)
        step = np.stack([np.bincount(features, off[doc, k], minlength=FEATURES) for k in range(len(names))], axis=1) + DECAY * model.weights / len(y)
        square += (step**2).sum(axis=1)
        model.weights -= RATE * step / np.sqrt(square)[:, None]
        model.bias -= RATE * off.sum(axis=0)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: Column | None = None, label_id: str = "doc_id") -> Classifier | None:
    """A classifier from at most SAMPLE labelled documents, those of the least hashes of their ids."""
    known = labels.select(F.col(label_id).cast("long").alias("id"), (domain(F.col("quality"), F.col("toxic")) if label is None else label).alias("domain")).where("id is not null and domain is not null")
    chosen = {r.id: r.domain for r in known.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()}
    if not chosen:
        return None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    got = rows.mapInArrow(_sample(chosen), "id long, domain string, features array<int>").dropDuplicates(["id"]).orderBy("id").toArrow()
    if not got.num_rows:
        return None
    lists = got.column("features").combine_chunks()
    return fit(lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.int64), got.column("domain").to_pylist())


def _memberships(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, sizes, first, features in _words(batch):
                p = model.posterior(first, features)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), flat], names=["id", "tokens", "p"])

    return run


def _moved(steps: list[tuple[np.ndarray, float]]) -> Column:
    """(r, y): a document's rate after the steps, and the point ahead of it that the next step starts from."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return start
    each = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in c]).alias("c"), F.lit(float(b)).alias("b")) for c, b in steps])
    dot = lambda c: F.aggregate(F.zip_with("p", c, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    def step(a: Column, s: Column) -> Column:
        new = F.array(F.greatest(F.lit(0.0), a.y - dot(s.c)))
        return F.element_at(F.transform(new, lambda r: F.struct(r.alias("r"), (r + s.b * (r - a.r)).alias("y"))), 1)

    return F.aggregate(each, start, step)


class Fit:
    """A classifier and the steps of the rates; miss is the greatest difference from a target as a share of all tokens."""

    def __init__(self, model: Classifier | None, steps: list[tuple[np.ndarray, float]], miss: float):
        self.model, self.steps, self.miss = model, steps, miss

    def columns(self, rows: DataFrame) -> DataFrame:
        """rows (id, p) with rate and copies: the rate rounded up or down by a hash of id and posterior, with the rate as expectation."""
        luck = F.pmod(F.xxhash64("id", "p", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.withColumn("rate", _moved(self.steps).r)
        return rows.withColumn("copies", (F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


Targets = dict[str, float] | Callable[[dict[str, float]], dict[str, float]]


def fitted(table: DataFrame, model: Classifier, targets: Targets) -> Fit:
    """Fits the rates of a table (tokens, p) by projected gradient steps."""
    k = len(model.domains)
    t = F.col("tokens").cast("double")

    def sums(cells: list, rows: DataFrame = table) -> np.ndarray:
        return np.array([float(x or 0) for x in rows.agg(*[F.sum(c).alias(f"c{n}") for n, c in enumerate(cells)]).first()])

    def tokens(steps: list, which: str) -> np.ndarray:
        return sums([F.col("at") * t * F.col("p")[i] for i in range(k)], table.select("tokens", "p", _moved(steps)[which].alias("at")))

    places = [(i, j) for i in range(k) for j in range(i + 1)]
    got = sums([t * F.col("p")[i] for i in range(k)] + [t * F.col("p")[i] * F.col("p")[j] for i, j in places])
    totals, moment = got[:k], np.zeros((k, k))
    for value, (i, j) in zip(got[k:], places):
        moment[i, j] = moment[j, i] = value
    n = max(1.0, totals.sum())
    if callable(targets):
        want = targets(dict(zip(model.domains, totals.tolist())))
    else:
        want = {d: n * w / sum(targets.values()) for d, w in targets.items()}
    goal = np.array([want.get(d, 0.0) for d in model.domains])
    measure = np.linalg.inv(moment + 1e-9 * n * np.eye(k))
    steps: list[tuple[np.ndarray, float]] = []
    off, last, pace = totals - goal, np.inf, 1.0
    while np.abs(off).max() > ENOUGH * n and len(steps) < STEPS:
        now = float(off @ measure @ off)
        pace, last = (pace if now <= last else 1.0), now
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        steps.append((measure @ off, (pace - 1) / faster))
        pace = faster
        off = tokens(steps, "y") - goal
    if steps:
        steps[-1] = (steps[-1][0], 0.0)
        off = tokens(steps, "r") - goal
    return Fit(model, steps, float(np.abs(off).max() / n))


def fit_rates(docs: DataFrame, labels: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", **how) -> tuple[Fit, DataFrame | None]:
    """(fit, the written table of id, tokens, p). With no labelled document there is no table and every rate is 1."""
    spark = docs.sparkSession
    model = learn(docs, labels, id_col, text_col, **how)
    if model is None:
        return Fit(None, [], 0.0), None
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(model)
    table = Scratch(spark, "mixing").save(rows.mapInArrow(_memberships(shared), f"id {kind}, tokens long, p array<double>"), "memberships")
    fit = fitted(table, model, targets)
    if fit.miss > 10 * ENOUGH:
        warnings.warn(f"no rates meet the targets: {fit.miss:.4f} of all tokens missed", stacklevel=2)
    return fit, table


def rates(docs: DataFrame, labels: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: id_col, tokens, rate, copies, membership (a map of posteriors), miss.

    targets: weights of domains, whose tokens are to add up to what there is, or
    a function from the present expected tokens to the targets. A domain without
    a target gets 0. A text that is null or empty has no tokens and the mean
    posterior; its rate is as any other's, and so is that of a null or repeated
    id. copies is the rate rounded up or down by a hash of id and posterior, with
    the rate as expectation: equal rows get the same. miss is the same in all
    rows: what the best rates found miss a target by, as a share of all tokens.
    With no labelled document every rate is 1 and tokens are not counted (0). An
    empty table gives an empty table.
    """
    fit, table = fit_rates(docs, labels, targets, id_col, text_col, **how)
    if fit.model is None:
        return docs.select(F.col(id_col), F.lit(0).cast("long").alias("tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(None).cast("map<string,double>").alias("membership"), F.lit(0.0).alias("miss"))
    named = F.map_from_arrays(F.array(*[F.lit(d) for d in fit.model.domains]), "p").alias("membership")
    return fit.columns(table).select(F.col("id").alias(id_col), "tokens", "rate", "copies", named, F.lit(fit.miss).alias("miss"))


def mixed(docs: DataFrame, labels: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with each row as often as its copies say; all columns stay, whatever their names.

    Posteriors are computed again beside the rows, so nothing is joined or
    shuffled, and rows with null or shared ids have their own copies.
    """
    fit, _ = fit_rates(docs, labels, targets, id_col, text_col, **how)
    if fit.model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(fit.model)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _memberships(shared)
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["id", "text"])
            at = 0
            for part in of(iter([own])):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, part.num_rows), batch.column("id").slice(at, part.num_rows), part.column("p")], names=["row", "id", "p"])
                at += part.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(beside, f"row {docs.schema.simpleString()}, id {kind}, p array<double>")
    return fit.columns(rows).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
