"""Whitening of vectors along their principal components.

The fit list has each distinct vector of whole numbers once: n vectors with sums S. Tasks reduce their centred rows
(n x - S) / n to a triangle each, block by block, by QR; triangles are merged in rounds of ``FAN``, so no task and no driver
sees more than ``FAN`` of them. The last triangle is made bidiagonal by Householder reflections, its singular values come from
differential qd steps, the directions from twisted factorisations (``qd``). Rows are projected where they are.

Vectors that are null or hold null or not finite components take no part. Shorter vectors count as padded with zeros.
Components without variance (standard deviation up to 1e-10 of the largest) don't exist, so a table with fewer than two
distinct vectors gives no rows. Rows repeated give the same result each, null ids too. Whole numbers are held at 62 bits,
deviations at 63. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .qd import principal
from .vectors import SAFE, finite, floored, stacked

FAN, NOISE = 32, 1e-10


@dataclass
class Whitening:
    """``mean`` is S / n; ``directions``: unit eigenvectors as columns, ``values``: their variances, falling."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python integers where 62 bits may not do."""
        most = max((abs(int(f(x))) for f in (np.min, np.max) if x.size), default=0)
        if most * self.n + max(map(abs, self.sums), default=0) >= SAFE:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.directions) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        y = self.lifted(x)
        most = max((abs(int(f(y))) for f in (np.min, np.max) if y.size), default=0)
        if most * most * max(y.shape[1], 1) >= SAFE:
            y = y.astype(object)
        return np.minimum((y**2).sum(1), (1 << 63) - 1).astype(np.int64)


def triangle(rows: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    return np.linalg.qr(rows if above is None else np.vstack([above, rows]), mode="r")


def reduced(vectors: DataFrame, fit: Whitening) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    width = len(fit.sums)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for batch in batches:
            r = triangle(fit.centred(stacked(batch["x"], width)), r)
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for batch in batches:
            for flat in batch["r"]:
                r = triangle(np.reshape(flat, (-1, width)), r)
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    parts = materialise(vectors.mapInPandas(blocks, "r array<double>"), "triangles")
    left = parts.count()  # one a task
    while left > FAN:
        left = -(-left // FAN)
        parts = materialise(parts.repartition(left).mapInPandas(merged, "r array<double>"), "triangles")
    r = None
    for row in parts.collect():  # at most FAN triangles
        r = triangle(np.reshape(row["r"], (-1, width)), r)
    return np.vstack([r, np.zeros((max(0, width - len(r)), width))])


def learn(vectors: DataFrame, width: int, components: int) -> Whitening | None:
    """From distinct vectors ``x`` of one width; None if nothing varies."""
    total = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    found = vectors.agg(F.count("*").alias("n"), *total).first()
    fit = Whitening(found["n"], [int(found[f"s{i}"] or 0) for i in range(width)], np.zeros((width, 0)), np.zeros(0), 0.0)
    if fit.n < 2 or not width:
        return None
    r = reduced(vectors, fit)
    squares, _ = principal(r, 0)
    real = int((squares > NOISE * NOISE * squares[0]).sum())
    if not real or not squares[0]:
        return None
    squares, fit.directions = principal(r, min(components, real))
    fit.values, fit.trace = squares[: fit.directions.shape[1]] / fit.n, float(squares.sum() / fit.n)
    return fit


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """Largest difference between the covariance of the whitened fit list, measured on its rows, and the identity."""
    width, k = len(fit.sums), len(fit.values)

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((k, k))
        for batch in batches:
            z = fit.whitened(stacked(batch["x"], width))
            out += z.T @ z
        yield pd.DataFrame({"at": np.arange(k * k), "s": out.ravel()})

    sums = vectors.mapInPandas(squares, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    same = F.when(F.col("at") % (k + 1) == 0, 1.0).otherwise(0.0)
    return float(sums.agg(F.max(F.abs(F.col("s") / fit.n - same))).first()[0])


def whiten(
    data: DataFrame, key: str, vector: str, *, components: int = 16, factor: float = 64.0, plus: int = 1_000_000
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row and component."""
    rows = data.where(finite(vector))
    width = rows.agg(F.max(F.size(vector))).first()[0] or 0
    padding = F.array_repeat(F.lit(plus).cast("long"), F.lit(width) - F.size(vector))
    rows = rows.select(F.col(key).alias("id"), F.concat(floored(vector, factor, plus), padding).alias("x"))
    vectors = materialise(rows.select("x").distinct(), "fit")
    fit = learn(vectors, width, components)
    if fit is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in OUT.items()]
        return rows.limit(0).select("id", *none)
    error = identity_error(vectors, fit)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        m = stacked(x, width)
        return pd.DataFrame({"deviation": fit.deviation(m), "whitened": list(fit.whitened(m))})

    explained: Column = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values])
    out = rows.select("id", project("x").alias("p")).select("id", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened"))
    return out.select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


OUT = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
