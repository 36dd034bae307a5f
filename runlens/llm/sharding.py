"""Shards of equal bytes by histogram sort.

The sort key is 64 bits: the upper half hashes the text, the lower half the id, so copies of a text are neighbours and
yet a large group of them is spread over the keys. Each round counts, exactly and over all partitions, the bytes and
rows between candidate boundaries, and refines the intervals that hold a splitter not met yet, or too many rows.
A splitter is met by a boundary between two texts if one is within the tolerance, else by one within a group of copies.
Then the rows are exchanged once, by interval, and numbered within it; the counts say where each interval starts.

The boundaries, about ``1024 + 64`` per round and splitter, are all that the driver gets. Null texts have size 1. Rows
equal in id and text share one key and can't be parted; they still get slots of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

FAN, ROUNDS = 64, 12
_GROUP = 1 << 32


def keys(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``size`` and ``__key`` in place of the text."""
    upper = F.shiftright(F.xxhash64(text), 32) * F.lit(_GROUP)
    lower = F.xxhash64(F.lit(7), key).bitwiseAND(F.lit(_GROUP - 1))
    rest = [c for c in docs.columns if c not in (text, "size", "__key")]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return docs.select(*rest, size.alias("size"), (upper + lower).alias("__key"))


def interval(boundaries: np.ndarray):
    """Number of the interval of a key: how many boundaries are at or below it."""

    @F.pandas_udf("int")
    def found(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(boundaries, key.to_numpy(np.int64), side="right").astype(np.int32))

    return found


def histogram(rows: DataFrame, boundaries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of each interval."""
    found = rows.select(interval(boundaries)(F.col("__key")).alias("i"), "size").groupBy("i")
    held = np.zeros((2, len(boundaries) + 1), dtype=object)
    held[:] = 0
    for r in found.agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        held[:, r["i"]] = r["b"], r["n"]
    return held[0], held[1]


def probes(low: int, high: int, fan: int) -> list[int]:
    """Up to ``fan`` keys within (low, high), between texts as long as there are such keys."""
    first, last = low // _GROUP + 1, (high - 1) // _GROUP
    unit, first, last = (_GROUP, first, last) if first <= last else (1, low + 1, high - 1)
    n = last - first + 1
    if n <= 0:
        return []
    return sorted({(first + n * i // min(n, fan)) * unit for i in range(min(n, fan))})


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002, intervals: int = 1024, least: int = 64, most: int = 500_000):
    """(boundaries, rows below each, chosen splitters). ``tolerance``: of a shard's bytes."""
    low, high = -(1 << 63), 1 << 63
    boundaries = np.array(probes(low, high, intervals), dtype=np.int64)
    for _ in range(ROUNDS):
        held, count = histogram(rows, boundaries)
        below, total, n = np.cumsum(held)[:-1], sum(held), sum(count)
        limit = min(max(n // intervals, least), most)
        slack = total * tolerance / shards
        edges = [low, *boundaries.tolist(), high]
        open_: set[int] = {i for i, c in enumerate(count) if c > 2 * limit}
        chosen = []
        for k in range(1, shards):
            target = total * k / shards
            missed = np.array([abs(float(b) - target) for b in below])
            between = np.array([b % _GROUP == 0 for b in boundaries.tolist()])
            fit = np.flatnonzero(between & (missed <= slack))
            best = int(fit[np.argmin(missed[fit])]) if len(fit) else int(np.argmin(missed))
            chosen.append(int(boundaries[best]))
            inside = int(np.searchsorted(np.array(below, dtype=float), target))
            if missed[best] > slack and count[inside] > 1:
                open_.add(inside)
        new = {p for i in open_ for p in probes(edges[i], edges[i + 1], FAN if count[i] > 2 * limit else 2 * FAN)}
        new = sorted(new - set(edges))
        if not new:
            break
        last = boundaries
        boundaries = np.array(sorted({*boundaries.tolist(), *new}), dtype=np.int64)
    else:
        boundaries = last
    return boundaries, np.cumsum(count)[:-1], sorted(chosen)


def shard(docs: DataFrame, key: str, text: str, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """``docs`` without the text, with ``size``, ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    rows = written(keys(docs, key, text), "keys")
    boundaries, rows_below, chosen = splitters(rows, shards, tolerance)
    below = np.concatenate(([0], rows_below)).astype(np.int64)
    of = np.searchsorted(np.array(chosen, dtype=np.int64), np.concatenate(([-(1 << 63)], boundaries)), side="right")
    first = np.array([below[np.searchsorted(of, s)] if s in of else 0 for s in range(shards)])

    @F.pandas_udf("shard int, start long")
    def place(i: pd.Series) -> pd.DataFrame:
        at = i.to_numpy(np.int64)
        return pd.DataFrame({"shard": of[at].astype(np.int32), "start": below[at] - first[of[at]]})

    within = Window.partitionBy("__i").orderBy("__key", key)
    numbered = rows.withColumn("__i", interval(boundaries)(F.col("__key"))).withColumn("__n", F.row_number().over(within) - 1)
    kept = [c for c in rows.columns if c not in ("__key", "shard", "slot")]
    out = numbered.withColumn("__p", place(F.col("__i")))
    return out.select(*kept, F.col("__p.shard").alias("shard"), (F.col("__p.start") + F.col("__n")).alias("slot"))
