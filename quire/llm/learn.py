"""What the classifiers share: labelled rows to learn from, and small fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null for a null id)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


#: Tasks that share the labelled rows.
PARTS = 16


def training_rows(df: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str, text: str, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled rows, chosen by a hash of the id, in at most PARTS partitions whatever the table's are.

    Several labels of one id count as the least, and of several texts of one id one is taken by
    its hash; null labels and ids don't count. The limit bounds what is broadcast to the documents' scan.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & allowed).groupBy(key).agg(F.min(label).cast("double").alias("y")).orderBy(F.xxhash64(key), key).limit(limit)
    found = df.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    one = found.groupBy(key).agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("row"))
    return one.select("row.*").coalesce(PARTS)


def isotonic(score: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores (ascending) and the rising fit of total / weight at them."""
    blocks: list[list[float]] = []
    for s, w, t in zip(score, weight, total):
        blocks.append([s, s, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    x = np.array([e for b in blocks for e in (b[0], b[1])])
    y = np.array([b[3] / b[2] for b in blocks for _ in range(2)])
    return x, y


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
