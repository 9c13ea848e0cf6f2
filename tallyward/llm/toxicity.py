"""Toxicity as cumulative-link ordinal regression on sparse text features.

Grades are the labels' own values in order, from 0, not toxic: as many thresholds as there
are grades above. P(grade > k) is the logistic of one score, shared by all thresholds, less
threshold k; the expected severity is the sum of these. Features are words and word
beginnings of 5 and 7 letters that are present in a text, kept where they tell toxic
documents apart in the labelled sample.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sample_of, table

#: Labelled documents that the model is fitted on, at most: those whose id hashes lowest.
SAMPLE = 20_000
#: Features kept, at most, by z.
FEATURES = 4096
#: A feature is kept if its documents are this many standard errors more toxic than all, and it has so many.
Z, LEAST = 4.0, 5
PREFIXES = (5, 7)
#: Probability of grade 1 or more from which a document is called toxic.
TOXIC = 0.4

_WORDS = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> set[str]:
    """Words and word beginnings ("achli*") present in a whole text, in lower case."""
    words = set(_WORDS((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, size: int, thresholds: int, rounds: int = 400, l2: float = 5e-5, rate: float = 0.1):
    """Weights and rising thresholds of a cumulative-link (logistic) model; full-batch Adam."""
    n = max(len(rows), 1)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0)]).astype(np.int64)
    p = np.zeros(size + thresholds)  # the last: the first threshold and the logs of the steps up from it
    p[size] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    cdf = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    grades = np.asarray(grades, dtype=np.int64)
    for t in range(1, rounds + 1):
        steps = np.exp(np.clip(p[size + 1 :], -6, 6))
        theta = p[size] + np.r_[0.0, np.cumsum(steps)]
        z = np.bincount(row, p[col], minlength=len(rows)) if len(rows) else np.zeros(0)
        over = cdf(z[:, None] - theta[None, :])  # P(grade > k)
        upper = np.c_[np.ones(len(rows)), over]
        lower = np.c_[over, np.zeros(len(rows))]
        prob = np.maximum((upper - lower)[np.arange(len(rows)), grades], 1e-9)
        slope = over * (1 - over)
        at = np.arange(thresholds)[None, :]
        # d log-likelihood / d (z - theta_k)
        d = slope * ((at == grades[:, None] - 1).astype(float) - (at == grades[:, None])) / prob[:, None]
        gz, gt = d.sum(axis=1) / n, -d.sum(axis=0) / n
        g = np.zeros_like(p)
        g[:size] = -np.bincount(col, gz[row], minlength=size) + l2 * p[:size]
        g[size] = -gt.sum()
        for k in range(1, thresholds):
            g[size + k] = -gt[k:].sum() * steps[k - 1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    steps = np.exp(np.clip(p[size + 1 :], -6, 6))
    return p[:size], p[size] + np.r_[0.0, np.cumsum(steps)]


class Model:
    """Feature names, weights and thresholds; a text's probabilities of each grade or more."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, np.asarray(thresholds)

    def above(self, texts) -> np.ndarray:
        w = self.weights
        kept = w.keys()
        z = np.array([sum(w[f] for f in features(t) & kept) for t in texts], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold=None) -> Model:
    """Fit on the labelled documents; ``fold``: a condition on labels that leaves some out.

    Labels that are null count as no label, values of 0 or less as not toxic; several of
    one document count as the worst, and several documents of one id as one of them.
    Without labels the model finds nothing toxic."""
    chosen = labels.where("toxic is not null and doc_id is not null")
    chosen = (chosen if fold is None else chosen.where(fold)).groupBy("doc_id").agg(F.greatest(F.max("toxic").cast("int"), F.lit(0)).alias("toxic"))
    chosen = sample_of(chosen, ["doc_id"], sample, 11).select(F.col("doc_id").alias("labelled"), "toxic")  # SAMPLE rows of 16 bytes: broadcast
    known = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), F.col("id") == F.col("labelled"))
    known = known.groupBy("labelled").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def found(batches):
        import pyarrow as pa

        for b in batches:
            names = [sorted(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.string()))], names=["toxic", "f"])

    known = materialise(known.select("toxic", "text").mapInArrow(found, "toxic int, f array<string>"), "toxic")
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if not n or not n_toxic or n_toxic == n:
        return Model({}, np.array([-40.0 if n_toxic else 40.0]))
    rate = n_toxic / n
    per = known.select((F.col("toxic") > 0).cast("int").alias("toxic"), F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST)
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = per.withColumn("z", z).where(F.col("z") >= Z).orderBy(F.desc("z"), "f").limit(FEATURES).collect()  # FEATURES rows
    names = [r.f for r in top]
    index = {f: k for k, f in enumerate(names)}

    def indexed(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[index[f] for f in fs if f in index] for fs in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "at"])

    rows = known.mapInArrow(indexed, "toxic int, at array<int>").toPandas()  # SAMPLE rows, the kept features each
    at, toxic = [np.asarray(a, dtype=np.int64) for a in rows["at"]], rows["toxic"].to_numpy()
    order = sorted(range(len(at)), key=lambda i: (toxic[i], at[i].tolist()))  # however the rows arrive
    at, toxic = [at[i] for i in order], toxic[order]
    grades = np.searchsorted(np.unique(toxic), toxic)
    w, theta = fit_ordinal(at, grades, len(names), int(grades.max()))
    return Model(dict(zip(names, w.tolist())), theta)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic (grade 1 or more), severity (expected grade) and grade (the most probable) of each row of docs.

    Null and empty texts have no features; long texts are taken whole. Repeated rows score
    alike; ties go to the lower grade; other columns are ignored; an empty table gives no
    rows."""

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                p = model.above(b.column(1).to_pylist())
                each = -np.diff(np.c_[np.ones(len(p)), p, np.zeros(len(p))], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32())], names=["doc_id", "p_toxic", "severity", "grade"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, p_toxic double, severity double, grade int")


def op3_ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = severity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("toxic", F.col("p_toxic") >= TOXIC)


QUERIES = {"op3_ordinal_toxicity": op3_ordinal_toxicity}
