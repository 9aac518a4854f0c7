"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (labelled 1) and unlabelled web text (documents without a label) are all that the classifier
learns from; labels of 0 are never read. With class prior p, positives' losses P+ and P- (as if positive, as if
negative) and the unlabelled loss U-, it minimises p * P+ + max(0, U- - p * P-) with logistic loss; when the second
part falls below zero the step goes the other way, which keeps it from fitting the positives as noise. The prior is
estimated from the two samples alone: a first classifier of positives against unlabelled scores held-out halves
of both, and the smallest ratio of the shares above a threshold (with its sampling error added) bounds the prior.

Features are hashed byte trigrams, the byte histogram, and shares of distinct words and lines. Learning uses
bounded samples (``POSITIVES`` and ``UNLABELLED`` rows, picked by a hash of doc_id); every text is scored whole.

Defined results: null text scores as the empty text. Where no positive or no unlabelled row is known, every score is
0.5. Repeated rows score alike. Of several labels of one document the largest counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .features import byte_grams, fold, thin, unit

DIMS = 2048
POSITIVES, UNLABELLED = 4000, 6000
ACCEPT = 0.7


def vector(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    words, lines = raw.split(), raw.split(b"\n")
    shares = np.array([len(set(words)) / max(len(words), 1), len(set(lines)) / len(lines), len(words) / (len(words) + 50)], np.float32)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32)
    return np.concatenate([unit(byte_grams(raw, DIMS)), unit(histogram), shares, [np.float32(1)]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(grad, dims: int, steps: int, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    w = np.zeros(dims, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = grad(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, steps: int = 150) -> float:
    """Share of positives among the unlabelled: the least ratio of the shares above a threshold, on rows not learned from."""
    p0, u0, p1, u1 = pos[::2], unl[::2], pos[1::2], unl[1::2]
    if not len(p1) or not len(u1):
        return 0.5

    def grad(w):
        return 0.5 * (p0.T @ (_sigmoid(p0 @ w) - 1)) / len(p0) + 0.5 * (u0.T @ _sigmoid(u0 @ w)) / len(u0)

    w = _adam(grad, pos.shape[1], steps)
    sp, su = np.sort(p1 @ w), np.sort(u1 @ w)
    above_p = 1 - np.searchsorted(sp, sp, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, sp, "left") / len(su)
    error = np.sqrt(np.log(40) / 2 / len(su)) + np.sqrt(np.log(40) / 2 / len(sp))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400) -> np.ndarray:
    """Weights that minimise the non-negative positive-unlabelled risk with logistic loss."""

    def grad(w):
        zp, zu = pos @ w, unl @ w
        as_positive = prior * (pos.T @ (_sigmoid(zp) - 1)) / len(pos)
        as_negative = (unl.T @ _sigmoid(zu)) / len(unl) - prior * (pos.T @ _sigmoid(zp)) / len(pos)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        return as_positive + as_negative if risk >= 0 else -as_negative

    return _adam(grad, pos.shape[1], steps)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray | None:
    """Weights learned from the rows of ``docs`` (doc_id, text) that are not held out and ``labels`` (doc_id, quality)."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kinds = ids.join(marks, "doc_id", "left").filter(F.col("quality").isNull() | (F.col("quality") == 1)).select("doc_id", F.col("quality").isNotNull().alias("positive"))
    counts = {r["positive"]: r["count"] for r in kinds.groupBy("positive").count().collect()}
    if len(counts) < 2:
        return None
    picked = thin(kinds.filter("positive"), F.col("doc_id"), positives, counts[True]).unionByName(thin(kinds.filter("not positive"), F.col("doc_id"), unlabelled, counts[False]))
    # The sample's ids are few whatever the input; their texts come from the scan without a shuffle.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    kind, rows = [], []
    for r in found.select("text", "positive").toLocalIterator():
        rows.append(vector(r["text"]))
        kind.append(r["positive"])
    kind, x = np.array(kind, bool), np.array(rows, np.float32)
    if kind.all() or not kind.any():
        return None
    return nnpu(x[kind], x[~kind], estimate_prior(x[kind], x[~kind]))


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``, in place of any column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value
        for texts in batches:
            yield pd.Series([0.5 if w is None else float(_sigmoid(vector(t) @ w)) for t in texts], dtype="float64")

    return docs.withColumn("score", rate(F.col(f"`{text}`")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
