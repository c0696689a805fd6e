"""Labelled rows for the classifiers, and the logistic fits that both use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that nothing is learnt from; a null doc_id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``most`` labelled rows outside the held-out fold.

    The rows are those of the least hash of doc_id, so the sample depends on the
    ids alone. Null labels and ids, and ids without a document, count for nothing.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` ids: small enough to broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps; columns are scaled to unit variance inside."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    mean = x.mean(axis=0)
    z = (x - mean) / scale
    n, p = z.shape
    step = 4.0 / max((np.linalg.norm(z, 2) ** 2) / n + 1.0, 1e-9)
    w, b = np.zeros(p), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = sigmoid(z @ v + c) - y
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return float(b - (w / scale) @ mean), w / scale
