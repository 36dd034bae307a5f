"""Connected components of links, by alternating large and small stars.

Links and labels stay distributed; each round is two aggregates and two joins keyed by vertex, checkpointed to the
shared folder. A round ends with fewer or the same links; when nothing changes, every vertex points at the smallest of
its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _large(links: DataFrame) -> DataFrame:
    """Every vertex's larger neighbours point at the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every vertex and its smaller neighbours point at the smallest of them; ``a > b`` in every link."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> ``a, root`` for every vertex but the roots."""
    turned = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links, seen = cut(turned.where("a <> b").distinct()), None
    while True:
        links = cut(_small(_large(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.withColumnRenamed("b", "root")
        seen = now
