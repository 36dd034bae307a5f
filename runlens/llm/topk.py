"""Exact top-k inner products as a Voronoi kNN join.

Equal vectors are first reduced to their ``k + 1`` smallest ids, which loses nothing. Data vectors belong to the cell of their
nearest pivot; there are about sqrt(N) pivots, ``PIVOTS`` at most. A vector is kept with its part along the direction of its pivot
and the length of the rest, and a cell is summed up by the extremes of these. For a query with parts a and b on the same direction,
the score with a vector of parts c and d is at most ac + bd.

1. *Local solve.* A query meets at most ``SEEDS`` vectors of each of the cells likely to be best for it. The k-th best score
   found, a real one, is a floor under its k-th best of all.
2. *Bounds.* Queries are grouped by pivots, about ``GROUP`` to a group. A group needs the cells whose extremes reach the floor of
   one of its queries, and has for each one bound over these queries.
3. *Replication.* A vector goes to a group only if its own two numbers reach the group's bound for its cell.
4. *Solution.* The vectors of a group are dealt by hash to parts of about ``BLOCK``, each part leaves the best k of each query, and
   a last aggregate merges those.

Cells with many vectors and groups with many queries are salted by their counts, so no block grows with the data, nor does
anything that the driver holds but for a few numbers per pivot.

Vectors that are null or hold null or not finite components take no part. A row is a query's own if it has its id.
Shorter vectors count as padded with zeros. Rows repeated with the same id are candidates each, and a repeated query id has one
result over all its rows. Of equal scores the smaller id comes first, null last. Scores beyond 64 bits are held at its limits.
Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BLOCK, GROUP, SEEDS, PIVOTS = 2048, 1024, 512, 1024


def whole(vector: str, factor: float) -> Column:
    """floor(factor * x) of each component, as longs; null if any component is null or not finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(F.lit(factor) * x)))


def matrix(vectors, width: int | None = None) -> np.ndarray:
    width = width or max([1, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return a, b


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows."""
    a, b = widened(a, b)
    most = [max([1, *(abs(int(f(x))) for f in (np.min, np.max) if x.size)]) for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Pivots:
    """Pivots and what a vector is relative to them."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres.astype(np.float64)
        norm = np.sqrt((self.centres**2).sum(1))[:, None]
        self.units = self.centres / np.where(norm > 0, norm, 1.0)

    def nearest(self, v: np.ndarray) -> np.ndarray:
        x, p = widened(v.astype(np.float64), self.centres)
        return ((p**2).sum(1)[None] - 2 * x @ p.T).argmin(1)

    def parts(self, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part along the pivot of ``cell``, length of the rest, length."""
        x, u = widened(v.astype(np.float64), self.units[cell])
        along = (x * u).sum(1)
        return along, np.sqrt(((x - along[:, None] * u) ** 2).sum(1)), np.sqrt((x**2).sum(1))

    def all_parts(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for every pivot; the rest is rounded up."""
        x, u = widened(v.astype(np.float64), self.units)
        along, square = x @ u.T, (x**2).sum(1)[:, None]
        return along, np.sqrt(np.maximum(square - along**2, 0) + 1e-13 * square), np.sqrt(square[:, 0])


NULL = -(1 << 63)


def ids_of(rows) -> np.ndarray:
    return np.array([NULL if r["id"] is None else r["id"] for r in rows], dtype=np.int64)


def best(queries, block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of queries with the rows of a block, and where the best ``k`` other rows of each query are, all ties included."""
    scores = products(matrix([r["v"] for r in queries]), matrix([r["v"] for r in block]))
    foreign = ids_of(block)[None] != ids_of(queries)[:, None]
    if scores.shape[1] > k:
        held = np.where(foreign, scores, np.iinfo(np.int64).min)
        foreign &= held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k][:, None]
    return scores, *np.nonzero(foreign)


def candidates(queries, block, k: int) -> pd.DataFrame:
    """The best ``k`` rows of a block for each query id; a null id is ``NULL`` here. Rows stand for ``n`` equal ones."""
    scores, row, col = best(queries, block, k)
    found = pd.DataFrame({"query_id": ids_of(queries)[row], "vec_id": ids_of(block)[col], "score": scores[row, col]})
    times = np.array([r["n"] for r in queries], dtype=np.int64)[row] * np.array([r["n"] for r in block], dtype=np.int64)[col]
    return pruned(found.loc[found.index.repeat(np.minimum(times, k))] if (times > 1).any() else found, k)


def pruned(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` highest scores of each query, ties to the smaller id, null last."""
    late = found["vec_id"].to_numpy() == NULL
    order = np.lexsort((found["vec_id"], late, -found["score"].clip(lower=NULL + 1), found["query_id"]))
    found = found.iloc[order]
    return found[found.groupby("query_id", sort=False).cumcount().to_numpy() < k]


@dataclass
class Join:
    """Data with cells, grouped queries with floors, and the bounds of each group for the cells that it needs."""

    data: DataFrame  # id, v, n, cell, salt, along, across, norm
    queries: DataFrame  # group, rows
    bounds: DataFrame  # group, cell, salt, low, high, across, norm, floor

    def replicated(self) -> DataFrame:
        """The rows of ``data`` that each group needs."""
        d, b = self.data.alias("d"), self.bounds.alias("b")
        most = F.greatest(F.col("b.low") * F.col("d.along"), F.col("b.high") * F.col("d.along")) + F.col("b.across") * F.col("d.across")
        room = F.col("b.norm") * F.col("d.norm") * 1e-9 + 1e-6  # for rounding
        return d.join(b, ["cell", "salt"]).where(most + room >= F.col("b.floor")).select("group", "id", "v", "n")


def per_pivot(numbers) -> Column:
    return F.lit([int(n) for n in numbers])


def dealt(salts: Column) -> Column:
    return F.pmod(F.xxhash64("id", "v"), salts).cast("int")


def divided(data: DataFrame, key: str, vector: str, is_query: Column, k: int, factor: float, pivots: int, group: int) -> Join | None:
    """Steps 1 and 2."""
    rows = data.select(F.col(key).alias("id"), whole(vector, factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    same = rows.where("v is not null").groupBy("id", "v").agg(F.count("*").alias("n"), F.count_if("q").alias("m"))
    same = materialise(same.select("id", "v", F.least("n", F.lit(k)).alias("n"), F.least("m", F.lit(k)).alias("m")), "vectors")
    chosen = same.orderBy(F.xxhash64("v"), "id").limit(max(1, min(pivots, isqrt(same.count())))).select("v").collect()
    if not chosen:
        return None
    at = Pivots(matrix([r["v"] for r in chosen]))
    count = len(chosen)

    @F.pandas_udf("cell int, along double, across double, norm double")
    def assign(v: pd.Series) -> pd.DataFrame:
        x = matrix(v.tolist())
        cell = at.nearest(x)
        along, across, norm = at.parts(x, cell)
        return pd.DataFrame({"cell": cell.astype(np.int32), "along": along, "across": across, "norm": norm})

    place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))
    few = same.select("id", "v", "n").withColumn("place", place).where(F.col("place") <= k + 1)
    placed = materialise(few.withColumn("a", assign("v")).select("id", "v", "n", "a.*"), "cells")
    first = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", "v")))
    seeds = placed.select("cell", "id", "v").withColumn("place", first).where(F.col("place") <= SEEDS)
    seeds = materialise(seeds.groupBy("cell").agg(F.collect_list(F.struct("id", "v")).alias("seeds")), "seeds")
    others = np.zeros(count)  # rows that are surely not the query's own
    for r in seeds.select("cell", (F.size(F.array_distinct(F.col("seeds.id"))) - 1).alias("n")).collect():
        others[r["cell"]] = r["n"]
    summary = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.avg("along").alias("mean"),
        F.max("across").alias("across"), F.max("norm").alias("norm"),
    ).collect()  # a row per pivot
    cells = np.array([s["cell"] for s in summary])
    size, low, high, mean, across, norm = (np.array([s[c] for s in summary]) for c in ("n", "low", "high", "mean", "across", "norm"))

    def homes_of(v: np.ndarray) -> list[list[int]]:
        """The cells that hold ``k`` other rows in their seeds, the most promising ones first."""
        order = np.argsort(np.where(others[cells] > 0, -at.all_parts(v)[0][:, cells] * mean, np.inf), axis=1)
        held = np.cumsum(others[cells][order], axis=1)
        needed = np.minimum((held < k).sum(1) + 1, (others > 0).sum())
        return [cells[o[:n]].tolist() for o, n in zip(order, needed)]

    @F.pandas_udf("cell int, homes array<int>")
    def settle(v: pd.Series) -> pd.DataFrame:
        x = matrix(v.tolist())
        return pd.DataFrame({"cell": at.nearest(x).astype(np.int32), "homes": homes_of(x)})

    asked = same.where("m > 0").select("id", "v", F.col("m").alias("n")).withColumn("a", settle("v"))
    asked = materialise(asked.select("id", "v", "n", "a.*"), "queries")
    met, own = np.zeros(count), np.zeros(count)
    for r in asked.select(F.explode("homes").alias("home")).groupBy("home").count().collect():
        met[r["home"]] = r["count"]
    for r in asked.groupBy("cell").count().collect():
        own[r["cell"]] = r["count"]

    # 1: a salt for about so many queries of a home
    salts = np.maximum(1, np.ceil(met / group))
    home = asked.withColumn("home", F.explode("homes")).withColumn("salt", dealt(per_pivot(salts)[F.col("home")]))
    home = home.groupBy("home", "salt").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), per_pivot(salts)[F.col("cell")] - 1)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, block in zip(batch["rows"], batch["seeds"]):
                scores, row, col = best(rows, block, k)
                parts = np.split(scores[row, col], np.searchsorted(row, np.arange(1, len(rows))))
                yield pd.DataFrame({
                    "id": pd.array([r["id"] for r in rows], dtype="Int64"), "v": [r["v"] for r in rows],
                    "scores": [np.sort(p)[::-1][:k] for p in parts],
                })

    met_rows = home.join(spread.withColumnRenamed("cell", "home"), ["home", "salt"]).select("rows", "seeds")
    found = met_rows.mapInPandas(solve, "id long, v array<long>, scores array<long>").groupBy("id", "v")
    found = found.agg(F.sort_array(F.flatten(F.collect_list("scores")), False).alias("scores"))
    floors = found.select(F.col("id").alias("fid"), F.col("v").alias("fv"), F.get("scores", F.lit(k - 1)).alias("floor"))
    asked = asked.join(floors, F.col("id").eqNullSafe(F.col("fid")) & (F.col("v") == F.col("fv")), "left")

    # 2: neighbouring cells make a group, one with many queries is cut into several
    lead = Pivots(at.centres[: max(1, min(count, ceil(own.sum() / group)))]).nearest(at.centres)
    many = np.maximum(1, np.ceil(np.bincount(lead, weights=own, minlength=lead.max() + 1) / group))
    start = np.cumsum(many) - many
    number = per_pivot(start[lead])[F.col("cell")] + dealt(per_pivot(many[lead])[F.col("cell")])
    groups = asked.groupBy(number.cast("long").alias("group")).agg(F.collect_list(F.struct("id", "v", "n", "floor")).alias("rows"))
    groups = materialise(groups, "groups")

    @F.pandas_udf("array<struct<cell int, low double, high double, across double, norm double, floor double>>")
    def needs(blocks: pd.Series) -> pd.Series:
        out = []
        for rows in blocks:
            # a score at the limit of 64 bits may stand for any lower one
            floor = np.array([-np.inf if r["floor"] is None or r["floor"] <= -(1 << 62) else float(r["floor"]) for r in rows])
            a, b, length = at.all_parts(matrix([r["v"] for r in rows]))
            a, b = a[:, cells], b[:, cells]
            most = np.maximum(a * low, a * high) + b * across + 1e-9 * length[:, None] * norm + 1e-6
            reached = most >= floor[:, None] - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0))[:, None]
            out.append([
                {"cell": int(cells[c]), "low": a[r, c].min(), "high": a[r, c].max(), "across": b[r, c].max(), "norm": length[r].max(), "floor": floor[r].min()}
                for c, r in ((c, reached[:, c]) for c in np.flatnonzero(reached.any(0)))
            ])
        return pd.Series(out)

    pieces = np.ones(count)
    pieces[cells] = np.ceil(size / (8 * BLOCK))
    bounds = groups.select("group", F.explode(needs("rows")).alias("b")).select("group", "b.*")
    bounds = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), per_pivot(pieces)[F.col("cell")] - 1)))
    return Join(placed.withColumn("salt", dealt(per_pivot(pieces)[F.col("cell")])), groups, materialise(bounds, "bounds"))


def search(
    data: DataFrame, key: str, vector: str, is_query: Column, k: int, factor: float = 64.0, pivots: int = PIVOTS, group: int = GROUP
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows of ``data`` for each row that ``is_query``."""
    spark = data.sparkSession
    join = divided(data, key, vector, is_query, k, factor, pivots, group)
    if join is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    counts = join.replicated().groupBy("group").count()
    counts = materialise(counts.select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "parts")

    # a given number of partitions: few bytes, much arithmetic, so they shouldn't be merged by size
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = join.replicated().join(counts, "group").select("group", dealt(F.col("parts")).alias("part"), "id", "v", "n")
    needed = needed.repartition(partitions, "group", "part").groupBy("group", "part")
    blocks = needed.agg(F.collect_list(F.struct("id", "v", "n")).alias("block"))
    asked = join.queries.join(counts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("group", "part", "rows").repartition(partitions, "group", "part")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for rows, block in zip(batch["rows"], batch["block"]):
                held.append(candidates(rows, block, k))
                if sum(map(len, held)) > 400_000:
                    held = [pruned(pd.concat(held), k)]
                    if len(held[0]) > 200_000:
                        yield named(held.pop())
        if held:
            yield named(pruned(pd.concat(held), k))

    def named(found: pd.DataFrame) -> pd.DataFrame:
        ids = {c: found[c].astype("Int64") for c in ("query_id", "vec_id")}
        return found.assign(**{c: x.mask(x == NULL) for c, x in ids.items()})

    found = asked.join(blocks, ["group", "part"]).select("rows", "block")
    found = found.mapInPandas(local, "query_id long, vec_id long, score long")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
