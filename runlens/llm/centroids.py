"""Centroid clustering on whole numbers: rounds of assignment through a vantage-point tree, exact in every step.

Each round the driver builds a tree over the ``k`` centroids and broadcasts it. A node holds a vantage centroid; its other
centroids are halved by their distance from it, and each half remembers the smallest and the largest of these distances.
A vector walks the tree best-first: of the halves it has not opened it takes the one with the smallest lower bound (by
the triangle inequality), measures the centroids there exactly, and stops when no bound is within its best distance. A bound
equal to it counts as within, so an equally near centroid with a smaller number is always seen. Vectors of a batch take
their steps together, each in its own order.

Vectors never move: a round is one scan that leaves the sums of ``k`` clusters. Only the centroids (``k`` rows) reach the
driver. Sums are decimals where 63 bits may not do.

Vectors that are null, of another width, or hold null or not finite components take no part. Starting centroids are the vectors
with the smallest hashes of their ids; equal ids are told apart by the vector, null ids come last. With fewer vectors than
``k`` each is a start. Repeated rows count each. Components and distances beyond 62 bits are held there. An empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .vectors import SAFE, finite, floored, squared, stacked

LEAF = 3


@dataclass
class Node:
    """``members``: centroids measured here, the vantage first. ``halves``: (node, nearest, farthest) as seen from it."""

    members: np.ndarray
    halves: list[tuple[int, float, float]] = field(default_factory=list)


@dataclass
class Tree:
    centroids: np.ndarray
    nodes: list[Node]


def build(centroids: np.ndarray) -> Tree:
    """A node for more than ``LEAF`` centroids measures one of them and halves the rest by rank, so equal ones end too."""
    nodes: list[Node] = []

    def grow(members: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(Node(members))
        if len(members) > LEAF:
            # the vantage: far from the middle, so that distances from it differ
            middle = centroids[members].astype(np.float64).mean(0)
            far = ((centroids[members].astype(np.float64) - middle) ** 2).sum(1)
            vantage = members[far.argmax()]
            rest = members[members != vantage]
            away = np.sqrt(squared(centroids[[vantage]], centroids[rest])[0].astype(np.float64))
            order = np.argsort(away, kind="stable")
            nodes[at].members = np.array([vantage])
            for part in np.array_split(order, 2):
                nodes[at].halves.append((grow(rest[part]), float(away[part].min()), float(away[part].max())))
        return at

    if len(centroids):
        grow(np.arange(len(centroids)))
    return Tree(centroids, nodes)


def nearest(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row (the smaller one of equals), squared distance, distances measured."""
    n, measured = len(x), 0
    best, at = np.zeros(n, dtype=np.int64), np.full(n, -1)
    radius = np.full(n, np.inf)
    bounds = np.full((n, len(tree.nodes)), np.inf)
    bounds[:, 0] = 0
    walking = np.arange(n)
    while len(walking):
        to = bounds[walking].argmin(1)
        low = bounds[walking, to]
        within = np.isfinite(low) & (low <= radius[walking])
        walking, to = walking[within], to[within]
        for number in np.unique(to):
            rows, node = walking[to == number], tree.nodes[number]
            parent = bounds[rows, number]
            bounds[rows, number] = np.inf
            exact = squared(x[rows], tree.centroids[node.members])
            measured += exact.size
            if exact.dtype == object:
                best = best.astype(object)
            for column, centroid in enumerate(node.members):
                d = exact[:, column]
                closer = (at[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (centroid < at[rows]))
                best[rows[closer]], at[rows[closer]] = d[closer], centroid
            # room for the rounding of the roots
            radius[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + 1e-12)
            away = np.sqrt(exact[:, 0].astype(np.float64))
            for half, near, far in node.halves:
                room = 1e-12 * (away + far)
                bounds[rows, half] = np.maximum(parent, np.maximum(near - away, away - far) - room)
    return at, best, measured


def assign(tree, width: int):
    """A column function of vectors: ``cluster`` and ``distance``; ``tree`` is a broadcast."""

    @F.pandas_udf("cluster int, distance long")
    def walk(v: pd.Series) -> pd.DataFrame:
        at, best, _ = nearest(stacked(v, width), tree.value)
        return pd.DataFrame({"cluster": at.astype(np.int32), "distance": np.minimum(best, SAFE).astype(np.int64)})

    return walk


@dataclass
class Clusters:
    """``assigned``: id, cluster, distance. ``centroids``: cluster, centroid."""

    assigned: DataFrame
    centroids: DataFrame


def starts(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    hashed = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def means(rows: DataFrame, walk, centroids: np.ndarray, kind: str) -> np.ndarray:
    """Floors of the exact means of the clusters; an empty cluster keeps its centroid."""
    width = centroids.shape[1]
    sums = [F.sum(F.col("v")[i].cast(kind)).alias(f"s{i}") for i in range(width)]
    found = rows.groupBy(walk("v")["cluster"].alias("cluster")).agg(F.count("*").alias("n"), *sums).collect()  # a row per centroid
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def cluster(
    data: DataFrame, key: str, vector: str, *, k: int = 16, rounds: int = 3, width: int = 64, factor: float = 64.0, salt: str = "1:"
) -> Clusters:
    spark: SparkSession = data.sparkSession
    rows = data.where(finite(vector) & (F.size(vector) == width)).select(F.col(key).alias("id"), floored(vector, factor).alias("v"))
    rows = materialise(rows, "vectors")
    most = F.array_max(F.transform("v", F.abs))
    size, largest = rows.agg(F.count("*"), F.coalesce(F.max(most), F.lit(0))).first()
    kind = "long" if size * largest < SAFE else "decimal(38,0)"
    centroids = starts(rows, k, salt)
    if not len(centroids):
        empty = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(empty, rows.select(F.lit(0).alias("cluster"), F.col("v").alias("centroid")))
    for _ in range(rounds):
        centroids = means(rows, assign(spark.sparkContext.broadcast(build(centroids)), width), centroids, kind)
    last = assign(spark.sparkContext.broadcast(build(centroids)), width)
    assigned = materialise(rows.select("id", last("v").alias("a")).select("id", "a.*"), "assigned")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    return Clusters(assigned, table)


def inertia(found: Clusters) -> DataFrame:
    """``cluster, centroid, cluster_inertia, inertia``: a row per cluster that has vectors."""
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = found.assigned.groupBy("cluster").agg(wide.alias("s"))  # a row per centroid
    whole: Column = F.sum("s").over(Window.partitionBy())
    held = [F.least(c.cast("decimal(38,0)"), F.lit(SAFE).cast("decimal(38,0)")).cast("long") for c in (F.col("s"), whole)]
    return per.join(found.centroids, "cluster").select("cluster", "centroid", held[0].alias("cluster_inertia"), held[1].alias("inertia"))
