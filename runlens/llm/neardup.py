"""Near duplicates by a chosen-path set similarity join.

A document's set are its distinct word shingles. Texts with equal sets are one class, however many, and a class is
compared once. Each class has a sketch of ``SKETCH`` minwise tokens. A tree sends a class to the node of one of its
tokens; a node with more than ``LEAF`` classes branches again by a token that the node chooses, up to ``DEPTH`` times.
Trees are independent: a pair of similarity s whose nodes branch d times meets in one of the leaves of t trees with
probability 1 - (1 - s ** (d + 1)) ** t. There are as many trees as give ``RECALL`` for s at the threshold and d = ``DEPTH``:
12 at 0.85, 18 at 0.8. The first tree tokens are those of the sketch, so there are at most ``SKETCH`` trees: enough for
thresholds of 0.64 and more.

First each node compares its classes with one of them, its pivot. Links are confirmed on full sets, and the components
that they make are known before nodes are compared exhaustively: only classes of different components still matter, so
a large group of near copies, once joined, costs nothing more, and a node of one component is done.

Leaves compare exhaustively, and so do nodes that stay large at the last depth: those outside a node's largest component
with all. A pair goes on to the full sets if its sketches agree often enough (``agree``: missed with probability below
1e-4 at the threshold). Nodes of more than ``SMALL`` classes are compared in blocks of bounded size, first of sketches,
then of the full sets of the classes that are in such a pair: a task gets two blocks and returns only links that join
components, so the many pairs just below the threshold that a large group of loose copies has are never written.
Smaller nodes write their pairs, and those that blocks have not joined meanwhile are confirmed one by one.

Empty sets are linked with nothing. The component of a document is the smallest id in it; a null id alone has none.
Rows equal in id and text are one document. Shingles are 64-bit hashes; classes have 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, written
from .links import components
from .rows import ID, TIE, give, keyed, sifted
from .textbytes import mix, shingles
from .wordids import slices

SKETCH, LEAF, DEPTH, SMALL = 64, 96, 4, 16
#: of pairs at the threshold in nodes that branch as often as they may
RECALL = 0.999
#: classes of a block on the side that is probed and on the other, and shingles of either
PROBES, BLOCK, BLOCK_SHINGLES = 128, 512, 1 << 20
_SALTS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FACTORS = mix(_SALTS) | np.uint64(1)


def agree(percent: int, size: int = SKETCH, miss: float = 1e-4) -> int:
    """How many of ``size`` tokens two sets at the threshold share, but for a probability of ``miss``."""
    p, below = percent / 100, 0.0
    for m in range(size + 1):
        below += comb(size, m) * p**m * (1 - p) ** (size - m)
        if below > miss:
            return m
    return size


def trees(percent: int) -> int:
    """How many trees find a pair at the threshold with probability ``RECALL``, however often its nodes branch."""
    apart = 1 - (percent / 100) ** (DEPTH + 1)
    return min(SKETCH, ceil(log(1 - RECALL) / log(apart))) if apart else 1


def signature(text: Column, k: int) -> Column:
    """n_shingles, digest and sketch of each whole text; no digest and sketch for an empty set."""

    @F.arrow_udf("n long, digest binary, sketch array<int>")
    def found(texts: pa.Array) -> pa.Array:
        n, digest, sketch = [], [], []
        for part in slices(texts):
            for t in part.to_pylist():
                own = shingles(t, k)
                n.append(len(own))
                if len(own):
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    # the shingles are well mixed already: a multiplication and an addition order them anew
                    least = np.array([(own * f + s).min() for f, s in zip(_FACTORS, _SALTS)], dtype=np.uint64)
                    sketch.append((mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                else:
                    digest.append(None)
                    sketch.append(None)
        columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(columns, ["n", "digest", "sketch"])

    return found(text)


def sets(text: Column, k: int) -> Column:
    """The sorted shingles of each text, packed."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t, k).tobytes() for part in slices(texts) for t in part.to_pylist()], pa.binary())

    return packed(text)


def shared(a: str, b: str) -> Column:
    """How many shingles two packed sets have in common."""

    @F.arrow_udf("long")
    def counted(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            out.append(len(np.intersect1d(x, y, assume_unique=True)))
        return pa.array(out, pa.int64())

    return counted(a, b)


def paired(percent: int) -> Callable[[pa.Table], pa.Table]:
    """For two blocks, rows ``probe, node, digest, root, out, n, sketch``: the classes, ``node, digest, root, out, n``, that
    are in a pair of a probe and one of the others, of different components, whose sketches and sizes are near enough."""
    least = agree(percent)

    def kept(block: pa.Table) -> pa.Table:
        probe = block["probe"].to_numpy()
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        number: dict[bytes, int] = {}
        part = np.array([number.setdefault(r, len(number)) for r in block["root"].to_pylist()], dtype=np.int64)
        n = block["n"].to_numpy()
        sketch = np.array(block["sketch"].to_pylist(), dtype=np.int32).reshape(-1, SKETCH)
        others, used = sketch[right], np.zeros(len(probe), dtype=bool)
        for i in left:
            near = (others == sketch[i]).sum(axis=1) >= least
            near &= (part[right] != part[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
            used[i] |= near.any()
            used[right[near]] = True
        return block.filter(pa.array(used)).select(["node", "digest", "root", "out", "n"])

    return kept


def joining(percent: int) -> Callable[[pa.Table], pa.Table]:
    """For two blocks, rows ``probe, digest, root, set``: links between a probe and one of the others that join their
    components, at most one less than there are components."""

    def linked(block: pa.Table) -> pa.Table:
        probe, digest, root = (block[c].to_pylist() for c in ("probe", "digest", "root"))
        held = [np.frombuffer(x, dtype=np.uint64) for x in block["set"].to_pylist()]
        left = [i for i, p in enumerate(probe) if p]
        right = [i for i, p in enumerate(probe) if not p]
        links: list[tuple[bytes, bytes]] = []
        if left and right:
            sizes = np.array([len(held[i]) for i in right])
            known, codes = np.unique(np.concatenate([held[i] for i in right]), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            number = {r: k for k, r in enumerate(dict.fromkeys(root))}
            part = np.array([number[r] for r in root])
            others = np.array(right)
            for i in left:
                own = held[i]
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                flags = np.zeros(len(known), dtype=np.uint8)
                flags[at[known[at] == own]] = 1
                same = np.add.reduceat(flags[codes], starts, dtype=np.int64)
                near = others[100 * same >= percent * (len(own) + sizes - same)]
                parts, first = np.unique(part[near], return_index=True)
                for p, j in zip(parts, near[first]):
                    if p != part[i]:
                        links.append((digest[i], digest[j]))
                        part[part == p] = part[i]
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return linked


class _Join:
    """One run of the join over the classes of a table."""

    def __init__(self, docs: DataFrame, text: str, k: int, percent: int):
        self.text, self.k, self.percent, self.docs = text, k, percent, docs
        self.signed = materialise(docs.select(ID, TIE, signature(F.col(text), k).alias("s")).select(ID, TIE, "s.*"), "signatures")
        own = self.signed.where("n > 0").groupBy("digest")
        place = F.struct(F.col(ID).isNull().alias("late"), ID, TIE)
        self.classes = materialise(
            own.agg(F.min(place).alias("place"), F.min(ID).alias("least"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes"
        )
        self.sets: DataFrame | None = None

    def _near(self, a: str, b: str, na: str, nb: str) -> Column:
        """Sketches that agree often enough and sizes that allow the similarity."""
        same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
        sizes = 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)
        return sizes & (same >= agree(self.percent))

    def _ends(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("digest")).union(pairs.select("b"))

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of gathered digests whose full sets are similar enough."""
        left = self.sets.select(F.col("digest").alias("a"), F.col("set").alias("x"))
        right = self.sets.select(F.col("digest").alias("b"), F.col("set").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("same", shared("x", "y"))
        total = ((F.length("x") + F.length("y")) / 8).cast("long") - F.col("same")
        return materialise(both.where(100 * F.col("same") >= self.percent * total).select("a", "b"), "links")

    def _gather(self, wanted: DataFrame) -> None:
        """Have the full sets of the ``wanted`` digests as well."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("digest"), "digest", "left_anti")
        wanted = self.classes.join(wanted, "digest", "left_semi").select("digest", f"place.{ID}", f"place.{TIE}")
        # most texts aren't wanted: they leave the scan before the join shuffles
        wanted = materialise(wanted, "wanted")
        rows = sifted(self.docs.select(ID, TIE, self.text), wanted)
        wanted = wanted.withColumnsRenamed({ID: "__fid", TIE: "__ftie"})
        on = F.col(ID).eqNullSafe(F.col("__fid")) & (F.col(TIE) == F.col("__ftie"))
        rows = rows.join(wanted, on)
        new = materialise(rows.select("digest", sets(F.col(self.text), self.k).alias("set")), "sets").dropDuplicates(["digest"])
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def _rooted(self, links: DataFrame) -> DataFrame:
        return self.classes.select("digest").join(components(links).withColumnRenamed("a", "digest"), "digest", "left").select(
            "digest", F.coalesce("root", "digest").alias("root")
        )

    def _first_nodes(self) -> DataFrame:
        """Nodes of the first level that hold several classes: ``node, digest``."""
        tokens = F.transform(F.slice("sketch", 1, trees(self.percent)), lambda x, i: F.xxhash64(i, x))
        each = self.classes.select("digest", F.explode(tokens).alias("node"))
        held = materialise(each, "nodes")
        full = held.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "digest"), "digest")).alias("p"))
        # written, so that the join has plain tables on both sides and a large node can be split
        full = materialise(full.where("size > 1").select("node", "size", F.col("p.digest").alias("pivot")), "pivots")
        return materialise(held.join(full, "node"), "full")

    def _star(self, nodes: DataFrame) -> DataFrame:
        pairs = nodes.where("digest <> pivot").select(F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b"))
        return self._sketched(pairs.distinct())

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        c = self.classes
        left = c.select(F.col("digest").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        right = c.select(F.col("digest").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        return pairs.join(left, "a").join(right, "b").where(self._near("sa", "sb", "na", "nb")).select("a", "b")

    def _mixed(self, nodes: DataFrame) -> DataFrame:
        """Nodes whose classes are of several components, with their size and largest component."""
        nodes = written(nodes, "rooted")
        each = nodes.groupBy("node", "root").agg(F.count("*").alias("n"))
        size = each.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("m"))
        # written, so that the join has plain tables on both sides and a large node can be split
        size = materialise(size.where("size > m.n").select("node", "size", F.col("m.root").alias("main")), "sizes")
        return nodes.join(size, "node")

    def _pairs(self, nodes: DataFrame) -> DataFrame:
        """Pairs of different components within a node, one of them outside its largest component."""
        left = nodes.where("root <> main").select("node", F.col("digest").alias("a"), F.col("root").alias("ra"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        right = nodes.select("node", "main", F.col("digest").alias("b"), F.col("root").alias("rb"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        pairs = left.join(right, "node").where("ra <> rb and (rb = main or a < b)")
        return pairs.where(self._near("sa", "sb", "na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def _blocked(self, nodes: DataFrame, *columns: str) -> DataFrame:
        """Rows of ``nodes`` once for each pair of blocks of their node: ``node, l, r, probe`` and ``columns``."""
        count = lambda n, each: F.ceil(F.greatest(F.count(n) / each, F.sum(n) / BLOCK_SHINGLES))
        parts = nodes.groupBy("node").agg(count(F.when(F.col("out"), F.col("n")), PROBES).alias("ls"), count(F.col("n"), BLOCK).alias("rs"))
        each = nodes.join(parts, "node").withColumn("h", F.xxhash64("digest"))
        spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        probes = each.where("out").select("node", F.pmod("h", "ls").alias("l"), spread("rs").alias("r"), F.lit(True).alias("probe"), *columns)
        others = each.select("node", spread("ls").alias("l"), F.pmod("h", "rs").alias("r"), F.lit(False).alias("probe"), *columns)
        return probes.unionByName(others)

    def _candidates(self, nodes: DataFrame) -> DataFrame:
        """The classes of large nodes that are in a pair of near sketches."""
        nodes = nodes.withColumn("out", F.col("root") != F.col("main"))
        rows = self._blocked(nodes, "digest", "root", "out", "n", "sketch").groupBy("node", "l", "r")
        found = rows.applyInArrow(paired(self.percent), "node long, digest binary, root binary, out boolean, n long")
        return materialise(found.distinct(), "blocks")

    def _joined(self, nodes: DataFrame) -> DataFrame:
        """Links that join components within large nodes, found on gathered sets."""
        rows = self._blocked(nodes, "digest", "root").join(self.sets, "digest")
        return materialise(rows.groupBy("node", "l", "r").applyInArrow(joining(self.percent), "a binary, b binary"), "joined")

    def links(self) -> DataFrame:
        first = self._first_nodes()
        stars = materialise(self._star(first).distinct(), "pairs")
        self._gather(self._ends(stars).distinct())
        links = self._confirmed(stars)
        roots = materialise(self._rooted(links), "roots")
        nodes = first.select("node", "digest").join(roots, "digest")
        nodes = self._mixed(nodes).join(self.classes.select("digest", "sketch", "n"), "digest")
        done = []
        for depth in range(DEPTH + 1):
            nodes = materialise(nodes, f"depth{depth}")
            done.append(nodes if depth == DEPTH else nodes.where(F.col("size") <= LEAF))
            large = nodes.where(F.col("size") > LEAF)
            if depth == DEPTH or large.isEmpty():
                break
            way = F.pmod(F.xxhash64(F.lit(depth), "node"), F.lit(SKETCH)).cast("int")
            child = F.xxhash64("node", F.get("sketch", way))
            nodes = self._mixed(large.withColumn("node", child).drop("size", "main"))
        leaves = reduce(DataFrame.unionByName, done)
        large = self._candidates(leaves.where(F.col("size") > SMALL))
        pairs = materialise(self._pairs(leaves.where(F.col("size") <= SMALL)).distinct(), "pairs")
        self._gather(self._ends(pairs).union(large.select("digest")).distinct())
        links = links.unionByName(self._joined(large))
        roots = materialise(self._rooted(links), "roots")
        for end in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("digest").alias(end), F.col("root").alias(f"r{end}")), end)
        return links.unionByName(self._confirmed(pairs.where("ra <> rb").select("a", "b")))


def _linked(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[_Join, DataFrame]:
    """The run, and ``digest, root, place, least`` of its classes; a root stands for a component."""
    run = _Join(keyed(docs, key, text), text, k, percent)
    rooted = run._rooted(run.links())
    return run, materialise(rooted.join(run.classes.select("digest", "place", "least"), "digest"), "roots")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """``__id, __tie, n_shingles, component_id, digest`` per row of ``docs``."""
    run, rooted = _linked(docs, key, text, k, percent)
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.select("digest", "root").join(component, "root").select("digest", "component_id")
    out = run.signed.drop("sketch").join(rooted, "digest", "left")
    return out.select(ID, TIE, F.col("n").alias("n_shingles"), F.coalesce("component_id", ID).alias("component_id"), "digest")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id (null last, then the text's
    hash), and every empty one. Of rows equal in id and text one stays. Components are told apart by their root, not by
    their smallest id, which several may have."""
    run, rooted = _linked(docs, key, text, k, percent)
    first = rooted.groupBy("root").agg(F.min("place").alias("p")).select(f"p.{ID}", f"p.{TIE}")
    empty = run.signed.where("n = 0").select(ID, TIE).distinct()
    one = first.unionByName(empty).withColumn("__stays", F.lit(True))
    return give(keyed(docs, key, text), one).where("__stays").drop("__stays").dropDuplicates([ID, TIE]).drop(ID, TIE)
