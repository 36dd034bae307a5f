"""Columns and matrices of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE = 1 << 62


def finite(vector: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def floored(vector: str, factor: float, plus: int = 0) -> Column:
    """floor(factor * x) + plus of each component as longs, held at 62 bits."""
    wide = F.col(vector).cast("array<double>")
    most = F.lit(float(SAFE))
    return F.transform(wide, lambda x: F.floor(F.greatest(F.least(F.lit(factor) * x, most), -most)).cast("long") + F.lit(plus))


def stacked(vectors, width: int, dtype=np.int64) -> np.ndarray:
    """The vectors as rows, shorter ones padded with zeros."""
    vectors = list(vectors)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=dtype).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two integer matrices; Python integers where 62 bits may not do."""
    most = max((abs(int(f(m))) for m in (x, c) if m.size for f in (np.min, np.max)), default=0)
    if 4 * most * most * max(x.shape[1], 1) >= SAFE:
        x, c = x.astype(object), c.astype(object)
    elif 4 * most * most * max(x.shape[1], 1) < 1 << 53:
        # every sum is a whole number below 2^53, so the product in doubles is exact
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return ((x[:, None] - c[None]) ** 2).sum(2)
