"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and a multiple of the identity. A score
is the sigmoid of the difference of the Gaussian log-densities (Mahalanobis distances by cached Cholesky factors) and
of the log priors. Means and covariances come from all labelled rows given: sums of products are added up per
partition and then exactly, in decimals, so the order of partitions doesn't matter.

Null and empty texts have the statistics of a text without words, and a score. Labels in conflict for one document
aren't learned from. Without rows of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import STATISTICS, statistics
from .wordids import slices

D = len(STATISTICS)
POOLED, ROUND = 0.2, 0.02


def features(text: Column) -> Column:
    """The statistics of each whole text, ``array<double>``."""

    @F.arrow_udf("array<double>")
    def computed(texts: pa.Array) -> pa.Array:
        rows = [statistics(t) for part in slices(texts) for t in part.to_pylist()]
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64())
        return pa.ListArray.from_arrays(pa.array(np.arange(0, D * len(rows) + 1, D), pa.int32()), flat)

    return computed(text)


@dataclass
class Gaussian:
    mean: np.ndarray
    whiten: np.ndarray  # inverse of the Cholesky factor
    constant: float  # log prior and half the log determinant

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten.T
        return self.constant - 0.5 * np.einsum("ij,ij->i", z, z)


@dataclass
class Discriminant:
    """Classes 0 and 1 on scaled statistics; None: nothing was learned."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), 0.5)
        x = (x - self.centre) / self.scale
        difference = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(difference, -35, 35)))


def fit(rows: DataFrame, x: str, y: str, pooled: float = POOLED, round_: float = ROUND) -> Discriminant:
    """Learn from all ``rows``: ``x`` statistics, ``y`` 0 or 1."""
    upper = np.triu_indices(D + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, D + 1, D + 1))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            one = np.concatenate((np.ones((len(values), 1)), values), axis=1)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                total[k] += one[label == k].T @ one[label == k]
        n = len(upper[0])
        at = np.concatenate([np.arange(n) + k * n for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.concatenate([t[upper] for t in total]))], ["at", "value"])

    partial = rows.where(F.col(y).isin(0, 1)).select(F.col(x), F.col(y).cast("long")).mapInArrow(sums, "at long, value double")
    exact = partial.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value")).collect()
    n = len(upper[0])
    flat = np.zeros(2 * n)
    for r in exact:  # two upper triangles
        flat[r["at"]] = r["value"]
    moments = []
    for k in (0, 1):
        m = np.zeros((D + 1, D + 1))
        m[upper] = flat[k * n : (k + 1) * n]
        moments.append(m + np.triu(m, 1).T)
    return from_moments(moments, pooled, round_)


def from_moments(moments: list[np.ndarray], pooled: float = POOLED, round_: float = ROUND) -> Discriminant:
    """``moments[k]``: sum of (1, x) (1, x)' over the rows of class k."""
    counts = [m[0, 0] for m in moments]
    if min(counts) < 2:
        return Discriminant(np.zeros(D), np.ones(D), None)
    both = moments[0] + moments[1]
    centre = both[0, 1:] / both[0, 0]
    variance = np.diag(both[1:, 1:]) / both[0, 0] - centre**2
    scale = np.sqrt(np.maximum(variance, 1e-9))
    means = [(m[0, 1:] / m[0, 0] - centre) / scale for m in moments]
    covariances = []
    for m in moments:
        mean = m[0, 1:] / m[0, 0]
        covariances.append((m[1:, 1:] / m[0, 0] - np.outer(mean, mean)) / np.outer(scale, scale))
    shared = sum(c * n for c, n in zip(covariances, counts)) / sum(counts)
    classes = []
    for mean, c, n in zip(means, covariances, counts):
        c = (1 - pooled) * c + pooled * shared
        c = (1 - round_) * c + round_ * max(np.trace(c) / D, 1e-6) * np.eye(D)
        factor = np.linalg.cholesky(c + 1e-9 * np.eye(D))
        constant = float(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum())
        classes.append(Gaussian(mean, np.linalg.inv(factor), constant))
    return Discriminant(centre, scale, (classes[0], classes[1]))


def score(x: Column, model: Discriminant) -> Column:
    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        return pa.array(model.score(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)), pa.float64())

    return scored(x)


def agreed(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per key whose labels agree: ``__id``, ``__y``."""
    out = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__id"))
    return out.agg(F.min(label).alias("__y"), F.max(label).alias("__other")).where("__y = __other").drop("__other")
