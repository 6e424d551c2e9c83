"""Bounded, repeatable samples of rows to fit a classifier on, and a small optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SPOTS = 1 << 40


def spot(key: str, seed: int) -> Column:
    """A seeded place of each id in [0, 2**40)."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_SPOTS))


def share_below(n: int, count: int) -> int:
    """Places below this hold about 4 n of ``count`` rows: enough to take the first n of them."""
    return min(_SPOTS, 4 * n * _SPOTS // max(1, count) + 1)


def hashed_head(ids: DataFrame, n: int, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """``n`` rows of ``ids`` at most, the first by a seeded hash of the key.  All but
    about 4 n rows are filtered where they lie, so no task sorts more."""
    place = spot(key, seed)
    return ids.where(place < share_below(n, ids.count())).orderBy(place, key).limit(n)


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by Adam with a step size that falls to zero."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def rows_of(column) -> np.ndarray:
    """Rows of float16 vectors that came as binary."""
    values = column.to_pylist()
    return np.stack([np.frombuffer(x, np.float16) for x in values]).astype(np.float32) if values else np.empty((0, 0), np.float32)
