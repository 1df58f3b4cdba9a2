"""Labelled rows for fitting: a bounded, balanced sample that is the same at every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows ``doc_id, text, y`` of at most ``per_class`` whole documents of each class, and how
    many labelled documents each class has.

    Only ids outside the held-out fold with a label of 0 or 1 count; of several labels of one id
    the largest does, of several texts the largest. The sample are the ids that come first in a
    seeded order. Documents without an id or a label take no part.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {0: 0, 1: 0} | {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), "doc_id")
    first = [rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])  # 2 * per_class rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.max("text").alias("text")), counts


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method, lightly ridged on scaled values."""
    scale = float(x.std()) or 1.0
    a, b, z = 0.0, 0.0, x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weights * (p - y) * z).sum() + 1e-3 * a, (weights * (p - y)).sum() + 1e-6 * b])
        s = weights * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
        if abs(da) + abs(db) < 1e-9:
            break
    return a / scale, b
