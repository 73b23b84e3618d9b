"""Bounded samples of labelled rows and a logistic calibration, for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """Remainder of crc32 of the id's decimal digits by 5; rows with 0 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, label: str, value: int, most: int) -> list[str]:
    """Up to ``most`` whole texts of labelled training rows with this value, the same ones for the same table: those with the least hash of their id."""
    ids = labels.where((F.col(label) == value) & (fold() != 0)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # ids: at most ``most`` longs
    return [r.text or "" for r in sorted(found.collect(), key=lambda r: (r.doc_id, r.text or ""))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (p - y) + ridge * len(x) * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
