"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic examples; everything else is unlabelled text. Linear
numpy classifiers over binary word features minimise the risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss l. Where the second part, an estimate of the negatives' risk,
falls below zero, its gradient is followed upwards, so that flexible models
don't overfit the positives. The prior is the share of toxic rows among the
training labels. Several classifiers, each with its own draw of unlabelled texts, vote
with their mean margin.

Features are whole words and their beginnings and ends, chosen by how strongly their
document frequency differs between the samples.

Defined results: a null or empty text has no feature and is scored by the intercept;
without a confirmed positive all scores are 0. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

#: Documents sampled for training, in the mean: confirmed positives and unlabelled ones.
POSITIVES, UNLABELLED = 3000, 9000
FEATURES = 4096
CLASSIFIERS = 3
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
#: Standard errors by which a feature's document frequencies must differ.
CLEAR = 5.0
#: Words that a worker remembers.
REMEMBERED = 40_000
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    out = ["=" + word]
    n = len(word)
    for k in (4, 5, 6):
        if n > k:
            out.append("<" + word[:k])
            out.append(">" + word[-k:])
    return out


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, intercept: float):
        self.ids = {f: i for i, f in enumerate(features)}
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def found(self, text: str | None) -> set[int]:
        known, ids, out = self.known, self.ids, set()
        for w in set(_WORD.findall(text.lower())) if text else ():
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[w] = tuple(ids[f] for f in word_features(w) if f in ids)
            if got:
                out.update(got)
        return out

    def score(self, text: str | None) -> float:
        if not self.ids:
            return 0.0
        got = sorted(self.found(text))
        z = self.intercept + float(self.weights[got].sum() if got else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _samples(docs: DataFrame, labels: DataFrame, train) -> tuple[DataFrame, float]:
    """(doc_id, text, p, u): sampled texts, marked as positives, as unlabelled or as both; the prior."""
    marks = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & train(F.col("k")))
    n, pos = marks.agg(F.count("*"), F.sum("y")).first()
    total = docs.where(train(F.col("doc_id"))).count()
    if not pos or not total:
        return None, 0.0
    draw = lambda name: F.pmod(F.xxhash64("k", F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where((F.col("y") == 1) & (draw("p") < min(1.0, POSITIVES / pos))).select("k").distinct()
    rows = docs.where(train(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen.withColumn("p", F.lit(True))), "k", "left").withColumn("p", F.coalesce("p", F.lit(False)))
    rows = rows.withColumn("u", draw("u") < min(1.0, UNLABELLED / total)).where("p or u")
    return rows.withColumnRenamed("k", "doc_id"), pos / n


def learn(docs: DataFrame, labels: DataFrame, train, features: int = FEATURES) -> Model:
    """A model of the rows for which ``train(doc_id)`` holds.

    The sample is bounded by POSITIVES and UNLABELLED; document frequencies are
    counted by Spark, and the driver gets only the chosen features' ids.
    """
    rows, prior = _samples(docs, labels, train)
    if rows is None:
        return Model([], np.zeros(0), 0.0)
    rows = cut(rows, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, u = Counter(), Counter()
            for text, is_p, is_u in zip(*(c.to_pylist() for c in x.columns)):
                got = {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}
                if is_p:
                    p.update(got)
                if is_u:
                    u.update(got)
            names = list(p.keys() | u.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[f] for f in names], pa.int64()), pa.array([u[f] for f in names], pa.int64())], ["f", "p", "u"])

    n_p, n_u = rows.agg(F.sum(F.col("p").cast("long")), F.sum(F.col("u").cast("long"))).first()
    df = in_arrow(rows.select("text", "p", "u"), count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b = F.col("p") / float(max(1, n_p)), F.col("u") / float(max(1, n_u))
    both = (F.col("p") + F.col("u") + 1) / float(n_p + n_u + 2)
    z = F.abs(a - b) / F.sqrt(both * (1 - both) * (1 / max(1, n_p) + 1 / max(1, n_u)) + F.lit(1e-12))
    chosen = df.where("p + u >= 4").where(z >= CLEAR).orderBy(F.desc(z), "f").limit(features).select("f").collect()
    model = Model(sorted(r[0] for r in chosen), np.zeros(len(chosen)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [sorted(shared.value.found(t)) for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), x.column(3), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "p", "u", "ids"])

    got = sorted(in_arrow(rows, ids, "doc_id long, p boolean, u boolean, ids array<int>").collect())
    model.weights, model.intercept = train_ensemble([r.ids for r in got if r.p], [r.ids for r in got if r.u], len(chosen), prior)
    return model


def train_ensemble(pos: list[list[int]], unl: list[list[int]], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Mean weights and intercept of CLASSIFIERS models, each on all positives and its own draw of the unlabelled."""
    if not pos or not unl:
        return np.zeros(n), -10.0
    out = [np.zeros(n + 1)]
    rng = np.random.default_rng(7)
    for _ in range(CLASSIFIERS):
        pick = rng.choice(len(unl), size=max(1, 2 * len(unl) // 3), replace=False)
        out.append(train_nnpu(pos, [unl[i] for i in sorted(pick)], n, prior))
    mean = np.mean(out[1:], axis=0)
    return mean[:-1], float(mean[-1])


def train_nnpu(pos: list[list[int]], unl: list[list[int]], n: int, prior: float) -> np.ndarray:
    """Weights, with the intercept last, that minimise the non-negative risk by Adam."""
    rows = [*pos, *unl]
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(doc) else np.empty(0, np.int64)
    m, w = len(pos), np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        f = np.bincount(doc, w[col], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        loss_neg = np.logaddexp(0, f)  # l(-f)
        negatives = loss_neg[m:].mean() - prior * loss_neg[:m].mean()
        g = np.zeros(len(rows))
        if negatives >= 0:
            g[:m] = prior * (s[:m] - 1) / m - prior * s[:m] / m
            g[m:] = s[m:] / (len(rows) - m)
        else:
            g[:m] = prior * s[:m] / m
            g[m:] = -s[m:] / (len(rows) - m)
        grad = np.append(np.bincount(col, g[doc], n), g.sum())
        grad[:-1] += RIDGE * w[:-1]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        w -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [shared.value.score(t) for t in x.column(x.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], [*keep, "score", "predicted"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return in_arrow(rows, run, f"{types}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are predicted as toxic; all columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array([shared.value.score(t) < 0.5 for t in x.column(at).to_pylist()], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
