"""Approximate nearest neighbours by largest inner product: multi-index hashing of learned binary codes.

*Codes.* Vectors are scaled by the largest norm and get one more component that makes all of them equally long (0 for a query), so
the largest inner product is the smallest angle. ``BITS`` signs are taken after rotations that are learned on a sample of at
most ``SAMPLE`` vectors (iterative quantisation, each from another random start).

*Index.* A code is cut into ``PARTS`` substrings and each is indexed: entries of a substring lie in cells by its
leading bits, about ``BLOCK`` entries a cell; a fuller cell is cut into several blocks by row number. Every row is indexed.

*Probing.* Two codes within Hamming radius R agree in at least one substring i up to r_i, if the r_i + 1 add up to R + 1. A
query goes to the cells whose leading bits are that near to its own, the entries there are held against the r_i of their
substring, what passes against R on the whole code, and a pair counts where its first such substring is. So every code within R
is found, once.

*Radius.* The ``k`` nearest vectors are sought among all codes within h + ``DEVIATIONS`` sqrt(h (1 - h / BITS)), h being the
distance of the k-th nearest code: differing bits are binomial, so this is a bound in standard deviations that adapts to
each query and to every size of the table. A first round probes the radius that the sample makes likely. It tells the own
radius of each query that found ``k`` codes; those whose radius is larger are probed once more, each up to its own.
Queries that found fewer try the radius that would be likely for ``WIDER`` times as many, and so on, in the end all codes.
All codes within a query's radius are ranked again by their inner product in double precision. Nothing caps their number.
A task holds about ``HELD`` pairs, however many a round finds.

Vectors that are null, zero or hold null or not finite components take no part; shorter ones count as padded with zeros. A row is a
query's own if it has its id; null ids are candidates, never queries. Rows that agree on id and vector are one candidate. The lists of
a query id that has several vectors are merged; a candidate may stand there once for each. Of equal vectors only the
``k`` + 1 smallest ids can be in a list, so only these are indexed. Ties go to the smaller id, null last. An empty table
gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .vectors import finite, stacked

BITS, PARTS, SAMPLE, BLOCK, GROUP, DEVIATIONS = 512, 8, 4096, 8192, 8192, 2.0
WORD = BITS // PARTS  # bits of a substring, one machine word
PREFIX = 12  # leading bits of a cell, at most
SLICE = 32  # queries compared at once with a block
ASKED = 8 << 20  # bytes of query vectors that are broadcast at once
HELD = 400_000  # pairs that a task holds before it hands them on
WIDER = 16  # times as many codes in the next round, for queries that found too few
TAIL = 8  # rank in the sample from which smaller ranks are carried on


def rotations(x: np.ndarray, bits: int = BITS, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Directions whose signs lose little of the sample: columns of rotations fitted to their own signs."""
    width, rng, out = x.shape[1], np.random.default_rng(seed), []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return np.hstack(out)[:, :bits]


@dataclass
class Coder:
    directions: np.ndarray
    largest: float  # norm

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.largest
        rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return np.hstack([x, (rest * (not query))[:, None]])

    def words(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of ``PARTS`` words."""
        signs = self.lifted(x, query) @ self.directions > 0
        return np.packbits(signs, axis=1).view(">u8").astype(np.uint64)


def radii(radius: int, parts: int = PARTS) -> list[int]:
    """r_i of each substring, -1: not probed. Substrings have ``WORD`` bits, so the widest radius needs one only."""
    if radius >= BITS:
        return [WORD] + [-1] * (parts - 1)
    left = radius - parts + 1
    return [left // parts + (i < left % parts) for i in range(parts)]


def reach(h, deviations: float = DEVIATIONS):
    """Radius for a k-th distance of ``h``: numbers, arrays or columns."""
    if isinstance(h, Column):
        return F.floor(h + deviations * F.sqrt(h * (1 - h / BITS)))
    return np.floor(h + deviations * np.sqrt(h * (1 - h / BITS)))


def packed(rows: np.ndarray, words: np.ndarray) -> list[bytes]:
    """Entries of the index: row number and code, highest byte first."""
    both = np.hstack([rows.astype(np.int64).view(np.uint64)[:, None], words]).astype(">u8")
    return [r.tobytes() for r in both]


def unpacked(entries) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(entries), dtype=">u8").reshape(len(entries), 1 + PARTS).astype(np.uint64)
    return both[:, 0].astype(np.int64), both[:, 1:].copy()


def limited(own: Column) -> Column:
    """A query's entry with the radius up to which it asks, two bytes behind it."""
    return F.concat("e", F.unhex(F.lpad(F.hex(own), 4, "0")))


def unlimited(entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, codes and radii of ``limited`` entries."""
    own = np.frombuffer(b"".join(e[-2:] for e in entries), dtype=">u2").astype(np.int64)
    return *unpacked([e[:-2] for e in entries]), own


def within(queries: np.ndarray, codes: np.ndarray, part: int, limits: list[int], radius: int) -> tuple[np.ndarray, ...]:
    """Pairs (query, code, distance) within ``radius`` whose first substring within its limit is ``part``."""
    found = []
    for start in range(0, len(queries), SLICE):
        q = queries[start : start + SLICE]
        row, col = np.nonzero(np.bitwise_count(q[:, part, None] ^ codes[None, :, part]) <= limits[part])
        apart = np.bitwise_count(q[row] ^ codes[col])
        far = apart.sum(1, dtype=np.int64)
        keep = far <= radius
        for earlier in range(part):
            if limits[earlier] >= 0:
                keep &= apart[:, earlier] > limits[earlier]
        found.append((row[keep] + start, col[keep], far[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def near_enough(query: np.ndarray, row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Pairs within the radius that the pairs held so far allow; later ones can only make it smaller."""
    order = np.lexsort((h, query))
    query, row, h = query[order], row[order], h[order]
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    n = np.diff(np.append(start, len(query)))
    kth = h[np.minimum(start + k - 1, len(h) - 1)]
    keep = h <= np.repeat(np.where(n >= k, reach(kth), BITS), n)
    return query[keep], row[keep], h[keep]


def pairs_of(met, radius: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``query, row, h`` in pieces: the pairs of each ``part, queries, entries`` that met. A slice of queries is done at a
    time, so what is held depends neither on the radius nor on how many queries and entries meet."""
    limits, held, size = radii(radius), [], 0
    for part, queries, entries in met:
        (q_rows, q, own), (rows, codes) = unlimited(queries), unpacked(entries)
        for start in range(0, len(q), SLICE):
            a, b, h = within(q[start : start + SLICE], codes, part, limits, radius)
            a += start
            keep = h <= own[a]
            held.append((q_rows[a[keep]], rows[b[keep]], h[keep]))
            size += int(keep.sum())
            if size > HELD:
                held = [near_enough(*map(np.concatenate, zip(*held)), k)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield held.pop()
                    size = 0
    if size:
        yield near_enough(*map(np.concatenate, zip(*held)), k)


def cells(entry: str, bits: int) -> Column:
    """Leading bits of each substring of an entry."""
    if not bits:
        return F.array(*[F.lit(0)] * PARTS)
    top = [F.conv(F.hex(F.substring(entry, 9 + 8 * i, 2)), 16, 10).cast("int") for i in range(PARTS)]
    return F.array(*[F.shiftright(x, 16 - bits) for x in top])


def index(codes: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks ``part, cell, number, entries``, the number of ``blocks`` of each cell, and the leading bits of a cell."""
    bits = min(PREFIX, max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK)))))
    entries = codes.select("row", "e", F.posexplode(cells("e", bits)).alias("part", "cell"))
    sizes = entries.groupBy("part", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = materialise(sizes, "cells")
    entries = entries.join(F.broadcast(sizes), ["part", "cell"])  # PARTS << PREFIX rows at most
    entries = entries.withColumn("number", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    blocks = entries.groupBy("part", "cell", "number").agg(F.collect_list("e").alias("entries"))
    return materialise(blocks, "blocks"), sizes, bits


def probe(todo: DataFrame, blocks: DataFrame, sizes: DataFrame, bits: int, radius: int, k: int) -> DataFrame:
    """``query, row, h``: all codes within ``radius`` of a query that may be within its own radius, its ``own`` where
    ``todo`` has it.

    The queries of a cell are cut into groups as its entries are cut into blocks, and each group meets each block, so one
    pair of them is all that a row of the join holds."""
    limits = radii(radius)
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("part") + 1)
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda c: F.bit_count(c.bitwiseXOR(F.col("own"))) <= limit)
    own = F.least("own", F.lit(radius)) if "own" in todo.columns else F.lit(radius)
    asked = todo.select(F.col("row").alias("query"), limited(own).alias("e"), F.posexplode(cells("e", bits)).alias("part", "own"))
    asked = asked.select("query", "e", "part", F.explode(near).alias("cell")).join(F.broadcast(sizes), ["part", "cell"])
    per_cell = asked.groupBy("part", "cell", "blocks").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    per_cell = materialise(per_cell, "asked")
    asked = asked.join(F.broadcast(per_cell.drop("blocks")), ["part", "cell"])  # PARTS << PREFIX rows at most
    asked = asked.withColumns(
        {
            "number": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
            "group": F.pmod(F.xxhash64("query"), F.col("groups")).cast("int"),
        }
    )
    on = ["part", "cell", "number", "group"]
    # a given number of partitions: few bytes, much arithmetic, so they shouldn't be merged by size
    partitions = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(partitions, *on).groupBy(*on).agg(F.collect_list("e").alias("queries"))
    held = blocks.join(F.broadcast(per_cell), ["part", "cell"])
    held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(*on, "entries")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = (x for batch in batches for x in zip(batch["part"], batch["queries"], batch["entries"]))
        for query, row, h in pairs_of(met, radius, k):
            yield pd.DataFrame({"query": query, "row": row, "h": h})

    both = asked.join(held, on).select("part", "queries", "entries")
    return both.mapInPandas(look, "query long, row long, h int")


def likely_radius(queries: np.ndarray, codes: np.ndarray, n: int, k: int) -> int:
    """The radius within which most queries end, of ``n`` codes; ``codes`` is a sample that begins with the ``queries``.

    A query is in the sample whatever its size, so its own code says nothing about the others and is left out. What lies
    nearer than the sample shows is carried on from its nearest codes, as the tail of a normal distribution."""
    others = len(codes) - 1
    if not len(queries) or others < 1 or k + 1 >= n:
        return BITS
    apart = np.zeros((len(queries), len(codes)), dtype=np.int64)
    for part in range(PARTS):
        apart += np.bitwise_count(queries[:, part, None] ^ codes[None, :, part])
    apart[np.arange(len(queries)), np.arange(len(queries))] = BITS + 1
    apart = np.sort(apart, axis=1)[:, :others]
    rank = others * (k + 1) / n

    def at(rank: float) -> np.ndarray:
        place = min(max(rank - 0.5, 0), others - 1)
        low, high = apart[:, int(place)], apart[:, min(int(place) + 1, others - 1)]
        return low + (high - low) * (place - int(place))

    kth, inner = at(max(rank, TAIL)), min(8 * TAIL, others / 2)
    if rank < TAIL < inner:
        z = [NormalDist().inv_cdf(r / others) for r in (rank, TAIL, inner)]
        kth = kth - np.median(at(inner) - kth) * (z[1] - z[0]) / (z[2] - z[1])
    return int(min(BITS, max(0, reach(max(0.0, float(np.quantile(kth, 0.95)))))))


def wider_radius(queries: np.ndarray, codes: np.ndarray, n: int, k: int, radius: int) -> int:
    """The next radius for queries that found less than ``k`` codes within ``radius``."""
    while k < n:
        k *= WIDER
        if (next_one := likely_radius(queries, codes, n, k)) > radius:
            return next_one
    return BITS


def search(data: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best found for each row that ``is_query``."""
    spark = data.sparkSession
    kept = data.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector) if kept else F.col(vector).cast("array<double>")
    asks = F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull()
    rows = data.where(finite(vector) & F.exists(vector, lambda x: x != 0)).select(F.col(key).alias("id"), v.alias("v"), asks.alias("q"))
    rows = rows.groupBy("id", "v").agg(F.max("q").alias("q"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())))
    rows = rows.where(F.col("q") | (F.col("copy") <= k + 1)).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "rows")
    useful = F.col("copy") <= k + 1

    @F.pandas_udf("double")
    def norm(v: pd.Series) -> pd.Series:
        x = stacked(v, max(map(len, v)), np.float64)
        scale = np.abs(x).max(1)
        return pd.Series(scale * np.sqrt(((x / scale[:, None]) ** 2).sum(1)))

    n, width, most, n_asked = rows.select(useful.alias("useful"), F.size("v").alias("size"), norm("v").alias("norm"), "q").agg(
        F.count_if("useful"), F.max("size"), F.max("norm"), F.count_if("q")
    ).first()
    if not n:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    sample = stacked((r["v"] for r in rows.where(useful).orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect()), width, np.float64)
    coder = Coder(np.zeros((width + 1, 0)), most)
    coder.directions = rotations(coder.lifted(sample, False))
    learned = spark.sparkContext.broadcast(coder)

    def entries(query: bool):
        @F.pandas_udf("binary")
        def encode(row: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series(packed(row.to_numpy(), learned.value.words(stacked(v, width, np.float64), query)))

        return encode("row", "v").alias("e")

    blocks, sizes, bits = index(materialise(rows.where(useful).select("row", entries(False)), "codes"), n)
    asked = materialise(rows.where("q").select("row", entries(True)), "asked")
    learned_from = coder.words(sample[:256], True), coder.words(sample, False), n
    waiting = [(asked, likely_radius(*learned_from, k))]
    pairs = asked.select(F.col("row").alias("query"), "row").limit(0)
    while waiting:
        todo, radius = waiting.pop()
        if todo.isEmpty():
            continue
        found = materialise(probe(todo, blocks, sizes, bits, radius, k + 1), "pairs")
        first = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("h"))).where(F.col("at") <= k + 1)
        first = first.groupBy("query").agg(F.max("h").alias("kth"), F.count("*").alias("n"))
        own = F.when(F.col("n") > k, reach(F.col("kth"))).when(F.lit(radius >= BITS), F.lit(BITS))
        limits = materialise(first.select("query", own.cast("int").alias("own")).where("own is not null"), "limits")
        pairs = pairs.unionByName(found.join(limits, "query").where(f"own <= {radius} and h <= own").select("query", "row"))
        if radius >= BITS:
            continue
        again = todo.select("row", "e").join(limits.where(f"own > {radius}").select(F.col("query").alias("row"), "own"), "row")
        wider = limits.agg(F.max("own")).first()[0]
        if wider is not None and wider > radius:
            waiting.append((materialise(again, "asked"), min(wider, BITS)))
        fewer = todo.join(limits.select(F.col("query").alias("row")), "row", "left_anti")
        waiting.append((materialise(fewer, "asked"), wider_radius(*learned_from, k, radius)))

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((stacked(a, width, np.float64) * stacked(b, width, np.float64)).sum(1))

    def ranked(scored: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # pairs are dealt by row only; the vectors of queries come to them in shares of bounded size, so no pair carries a vector
    # through a shuffle
    shares = max(1, -(-n_asked * width * 8 // ASKED))
    asking = rows.where("q").select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("asked"))
    given = rows.where(useful).select("row", F.col("id").alias("vec_id"), "v")
    found = []
    for i in range(shares):
        share = F.pmod(F.xxhash64("query"), F.lit(shares)) == i
        scored = pairs.where(share).join(given, "row").join(F.broadcast(asking.where(share)), "query")
        scored = scored.where(~F.col("vec_id").eqNullSafe(F.col("query_id"))).select("query_id", "vec_id", product("asked", "v").alias("score"))
        found.append(ranked(scored) if shares == 1 else materialise(ranked(scored), "ranked"))
    return found[0] if shares == 1 else ranked(reduce(DataFrame.unionByName, found).drop("rank"))
