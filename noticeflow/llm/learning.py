"""Bounded training samples and small numpy fits shared by the learned operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents, one row each.

    The choice goes by a hash of doc_id, so it needs no pass over the texts and does not depend
    on the order of rows. The list of chosen ids is the only thing broadcast: ``limit`` rows.
    Repeated labels of a document count once, the smallest wins; null labels are no labels. Of
    repeated rows of a document the smallest text counts, so copies do not add up on the driver.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Collected rows sorted by doc_id, and which of them calibrate: a quarter, by a hash of doc_id.

    Neither depends on how the documents lie in files.
    """
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")]))
    mixed = rows.column("doc_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return rows, mixed >> np.uint64(62) == 3


def per_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Full-batch steps with decoupled weight decay."""

    def __init__(self, size: int, rate: float, decay: float) -> None:
        self.m, self.v, self.t, self.rate, self.decay = np.zeros(size), np.zeros(size), 0, rate, decay

    def step(self, weights: np.ndarray, slope: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (slope - self.m)
        self.v += 0.01 * (slope * slope - self.v)
        weights -= self.rate * (self.m / (1 - 0.9**self.t) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-9) + self.decay * weights)


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of P(1) = sigmoid(a score + b), fitted with smoothed targets."""
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    scale = scores.std() or 1.0
    x, (a, b) = scores / scale, (1.0, 0.0)
    for _ in range(50):
        p = sigmoid(a * x + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * x).mean() + 1e-3 * a, g.mean()
        haa, hab, hbb = (h * x * x).mean() + 1e-3, (h * x).mean(), h.mean() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return float(a / scale), float(b)
