"""Trees and graphs: ancestor paths, reachability, walking order, budgets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, materialise
from .ordered import scan


RUNS = 4  # levels kept apart


class CycleError(ValueError):
    """Parents that lead back to a node."""


def fold_up(
    df: DataFrame, keys: list[str], node: str, parent: str, values: dict[str, Column], joined: Callable[[Column, Column], Column] | dict
) -> DataFrame:
    """Folds over each node and all its ancestors. ``values``: name -> value of one node; ``joined(below, above)`` puts two
    neighbouring pieces of a chain together (one function, or one per name).

    Pointers are doubled each round (parent, grandparent, 4th ancestor, ...), so a tree of depth d needs log2(d) joins, and
    a node that has reached its root leaves them. The join key is one node, so a big run or a parent with many children is
    spread. A parent that is not in the table ends the chain like a root. In a forest of N nodes every pointer has ended after
    log2(N) + 1 rounds; one that hasn't is on a cycle."""
    joined = joined if isinstance(joined, dict) else dict.fromkeys(values, joined)
    state = cut(df.select(*keys, F.col(node).alias("__n"), F.col(parent).alias("__up"), *[v.alias(c) for c, v in values.items()]))
    rounds, most = 0, state.count().bit_length() + 1
    while True:
        climbing = state.filter(F.col("__up").isNotNull())
        if climbing.isEmpty():
            return state.drop("__up").withColumnRenamed("__n", node)
        if rounds > most:
            raise CycleError(f"the parents of {node} form a cycle")
        rounds += 1
        above = state.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__n").alias("__m"), F.col("__up").alias("__up2"),
            F.struct(*values).alias("__above"),
        )
        on = F.col("__up") == F.col("__m")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        met = F.col("__m").isNotNull()
        folded = [F.when(met, joined[c](F.col(c), F.col(f"__above.{c}"))).otherwise(F.col(c)).alias(c) for c in values]
        climbed = climbing.join(above, on, "left").select(*keys, "__n", F.col("__up2").alias("__up"), *folded)
        state = cut(climbed.unionByName(state.filter(F.col("__up").isNull())))


def tree_paths(df: DataFrame, keys: list[str], node: str, parent: str, payload: list[str] | None = None) -> DataFrame:
    """``path`` from the root to each node, as structs of the node and ``payload``; ``depth`` 0 for a root. Where only the depth
    or a test between two nodes is needed, ``tree_depths`` and ``intervals`` keep a few numbers instead."""
    item = F.array(F.struct(F.col(node).alias("node"), *(payload or [])))
    paths = fold_up(df, keys, node, parent, {"path": item}, lambda below, above: F.concat(above, below))
    return paths.select(*keys, node, "path", (F.size("path") - 1).cast("long").alias("depth"))


def tree_depths(df: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """``depth`` of each node, 0 for a root."""
    deep = fold_up(df, keys, node, parent, {"depth": F.lit(1).cast("long")}, lambda below, above: below + above)
    return deep.withColumn("depth", F.col("depth") - 1)


def intervals(df: DataFrame, keys: list[str], node: str, parent: str, order: str) -> DataFrame:
    """``first``, ``last``, ``depth``: nodes numbered from 0 in depth-first order, children by ``order`` (a number, unique below
    one parent), and the last number below each node. One node holds another if its interval holds the other's ``first``
    (``holds``), so no chains are stored.

    Two folds of log2(depth) rounds. Sizes of subtrees: what hangs 2^k below a node is added to what was counted up to
    there, as sums by ancestor, which leave the tasks as partial sums. Then each node is as far behind its parent as the
    sizes of its earlier siblings say, and these distances are summed along the chain."""
    state = cut(df.select(*keys, F.col(node).alias("__n"), F.col(parent).alias("__up"), F.lit(1).cast("long").alias("__size")))
    rounds, most = 0, state.count().bit_length() + 1
    while not state.filter(F.col("__up").isNotNull()).isEmpty():
        if rounds > most:
            raise CycleError(f"the parents of {node} form a cycle")
        rounds += 1
        hung = state.filter(F.col("__up").isNotNull()).groupBy(*keys, F.col("__up").alias("__n")).agg(F.sum("__size").alias("__more"))
        above = state.select(*keys, F.col("__n").alias("__up"), F.col("__up").alias("__up2"))
        state = state.join(hung, [*keys, "__n"], "left").withColumn("__size", F.col("__size") + F.coalesce("__more", F.lit(0)))
        state = cut(state.join(above, [*keys, "__up"], "left").select(*keys, "__n", F.col("__up2").alias("__up"), "__size"))
    sized = df.select(*keys, node, parent, order).join(state.select(*keys, F.col("__n").alias(node), "__size"), [*keys, node])
    placed = scan(sized, [*keys, parent], order, total={"__upto": "__size"})
    # a parent that is not in the table is none
    known = df.select(*keys, F.col(node).alias(parent), F.lit(1).cast("long").alias("__below"))
    placed = placed.join(known, [*keys, parent], "left")
    step = F.col("__upto") - F.col("__size") + F.coalesce("__below", F.lit(0))
    found = fold_up(placed.withColumn("__step", step), keys, node, parent, {"first": F.col("__step"), "depth": F.lit(1).cast("long"), "last": F.col("__size")}, {
        "first": lambda below, above: below + above, "depth": lambda below, above: below + above, "last": lambda below, above: below,
    })
    return found.select(*keys, node, "first", (F.col("first") + F.col("last") - 1).alias("last"), (F.col("depth") - 1).alias("depth"))


def holds(outer: str, inner: str) -> Column:
    """Whether the interval in the columns ``<outer>_first``, ``<outer>_last`` holds the node numbered ``<inner>_first``."""
    return F.col(f"{inner}_first").between(F.col(f"{outer}_first"), F.col(f"{outer}_last"))


def ancestors(paths: DataFrame, keys: list[str], node: str) -> DataFrame:
    """One row per node and proper ancestor: the ancestor, its distance and the path item below it."""
    n = F.size("path")
    steps = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            F.element_at("path", i)["node"].alias("ancestor"),
            (n - i).cast("long").alias("distance"),
            F.element_at("path", i + 1).alias("below"),
        ),
    )
    return paths.filter(n > 1).select(*keys, node, F.explode(steps).alias("a")).select(*keys, node, "a.*")


def block_ancestors(stmts: DataFrame, keys: list[str]) -> DataFrame:
    """Which block of statement ``ancestor`` holds statement ``stmt``."""
    paths = tree_paths(stmts, keys, "stmt", "parent", ["block"])
    return ancestors(paths, keys, "stmt").select(*keys, "stmt", "ancestor", F.col("below.block").alias("side"))


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Fewest hops from the start vertices, 0 for themselves; ``max_depth``: that many levels at most.

    ``edges(src, dst)``, ``start(v)``. Edges are made distinct once. The vertices reached so far are kept as runs: a new
    level is a run of its own, and beyond ``RUNS`` runs those of like size are merged, so a round meets ``RUNS`` + log2(vertices)
    of them at most and a vertex is seldom written again. Cycles end, as no vertex is reached twice."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(start.select("v").distinct().withColumn("depth", F.lit(0).cast("long")))
    runs: list[tuple[DataFrame, int]] = []
    depth, size = 0, frontier.count()
    while size:
        runs.append((frontier, size))
        while len(runs) > RUNS and runs[-2][1] <= 2 * runs[-1][1]:
            (old, n), (new, m) = runs[-2:]
            runs[-2:] = [(cut(old.unionByName(new)), n + m)]
        depth += 1
        if max_depth is not None and depth >= max_depth:
            break
        nxt = edges.join(frontier.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v")).distinct()
        for run, _ in runs:
            nxt = nxt.join(run, "v", "left_anti")
        frontier = cut(nxt.withColumn("depth", F.lit(depth).cast("long")))
        size = frontier.count()
    return reduce(DataFrame.unionByName, [run for run, _ in runs], frontier.limit(0))


def through_constructors(edges: DataFrame, classes: DataFrame, functions: DataFrame, constructor: str = "__init__") -> DataFrame:
    """Call edges where calling a class means calling its constructor: a class leads to ``<class>.<constructor>`` if there is
    such a function, and to nothing else.

    ``edges(src, dst)``, ``classes(v)``, ``functions(v)``."""
    own = classes.select("v").distinct()
    made = own.withColumn("dst", F.concat("v", F.lit(f".{constructor}")))
    made = made.join(functions.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("v").alias("src"), "dst")
    return edges.select("src", "dst").join(own.withColumnRenamed("v", "src"), "src", "left_anti").unionByName(made)


def walk_order(sites: DataFrame, entry: DataFrame, key: str) -> DataFrame:
    """Depth-first reading order without a sequential walk.

    ``sites(key, src, pos, dst)``: calls in the body of ``src``; ``entry(key, fn)``. A function is entered along its
    smallest path of call positions that visits no function twice; paths are improved until none gets smaller."""
    sites = cut(sites.select(key, "src", "pos", "dst"))
    best = cut(entry.select(key, "fn", F.array().cast("array<bigint>").alias("path"), F.array("fn").alias("via")))
    frontier = best
    while True:
        longer = (
            frontier.join(sites.withColumnRenamed("src", "fn"), [key, "fn"])
            .filter(~F.array_contains("via", F.col("dst")))
            .select(
                key, F.col("dst").alias("fn"),
                F.concat("path", F.array(F.col("pos").cast("long"))).alias("path"),
                F.concat("via", F.array("dst")).alias("via"),
            )
            .groupBy(key, "fn")
            .agg(F.min(F.struct("path", "via")).alias("s"))
            .select(key, "fn", "s.*")
        )
        old = best.select(key, "fn", F.col("path").alias("__old"))
        better = longer.join(old, [key, "fn"], "left").filter(F.col("__old").isNull() | (F.col("path") < F.col("__old"))).drop("__old")
        frontier = cut(better)
        if frontier.isEmpty():
            return best.select(key, "fn", "path")
        best = cut(best.join(frontier.select(key, "fn"), [key, "fn"], "left_anti").unionByName(frontier))


def reading_steps(sites: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """The call sites of all functions that are read, in reading order.

    ``sites(key, src, pos, dst, kind, parent, block)``: statement ``pos`` of ``src`` calls ``dst``; it stands in ``block`` of the statement
    ``parent`` of the same function. ``order`` comes from ``walk_order``. A function is entered at the one site its path ends
    with; every other site that calls it has ``see``, the number of that entering. ``step`` counts the sites and the enterings from 0.
    ``possible``: inside an if or match, or behind the body of a try; ``repeats``: inside a loop, both within the function.

    The numbers come from the tree of sites and enterings by ``intervals``, the flags by a fold over the blocks around a
    site, so both take log2(depth) rounds."""
    sites = cut(sites.join(order.select(key, F.col("fn").alias("src"), "path"), [key, "src"]))
    site = F.concat_ws(":", F.lit("s"), "src", "pos")
    way = order.select(key, F.col("fn").alias("dst"), F.col("path").alias("__way"))
    called = sites.join(way, [key, "dst"], "left").withColumn(
        "entered", F.coalesce(F.col("__way") == F.concat("path", F.array(F.col("pos").cast("long"))), F.lit(False))
    )
    called = cut(called.drop("path", "__way"))
    enter = order.select(key, F.concat_ws(":", F.lit("f"), "fn").alias("id"))
    via = called.filter("entered").select(key, F.concat_ws(":", F.lit("f"), "dst").alias("id"), site.alias("up"))
    tree = enter.join(via, [key, "id"], "left").withColumn("at", F.lit(0).cast("long"))
    tree = tree.unionByName(called.select(key, site.alias("id"), F.concat_ws(":", F.lit("f"), "src").alias("up"), F.col("pos").cast("long").alias("at")))
    number = intervals(cut(tree), [key], "id", "up", "at").select(key, "id", F.col("first").alias("step"))

    up = sites.select(key, "src", F.col("pos").alias("parent"), F.col("kind").alias("__around"))
    inner = sites.join(up, [key, "src", "parent"], "left")
    branchy = F.col("__around").isin("if", "match") | ((F.col("__around") == "try") & (F.col("block") != "body"))
    flags = {"possible": F.coalesce(branchy, F.lit(False)), "repeats": F.coalesce(F.col("__around").isin("for", "while"), F.lit(False))}
    around = fold_up(inner, [key, "src"], "pos", "parent", flags, lambda below, above: below | above)

    out = called.withColumn("id", site).join(number, [key, "id"]).join(around, [key, "src", "pos"])
    seen = number.select(key, F.col("id").alias("__to"), F.col("step").alias("see"))
    out = out.withColumn("__to", F.when(~F.col("entered"), F.concat_ws(":", F.lit("f"), "dst"))).join(seen, [key, "__to"], "left")
    return out.select(key, "step", "src", "pos", "dst", "entered", "see", "possible", "repeats")


def fit_budget(items: DataFrame, keys: list[str], order: list[str], size: str, budget: int, window: int = 1000) -> DataFrame:
    """Greedy budget in order: an item is kept if it still fits; later, smaller ones may still fit. Sizes are 0 or more.

    A round looks at the items that could still fit into what is ``left``, with T the largest power of two up to that. While
    T or more is left, every item below T fits, so what is left behind each item is a running total, and of the larger items
    only the first that fits into it can be kept. There, or where the small ones bring it below T, the round of a key ends
    with less than T left: at most log2(budget) + 1 rounds, whatever the sizes. A key with at most ``window`` such items
    is folded in one array and done. Both ways are exact. Running totals are cut into spans, so a hot key is spread."""
    items = materialise(scan(items, keys, order, row_number="__pos", ranges=True), "items")
    wide = items.select(*keys, "__pos", F.col(size).cast("long").alias("__size"))
    kept = wide.filter("__size <= 0").select(*keys, "__pos")
    left = items.select(*keys).distinct().withColumns({"__left": F.lit(budget).cast("long"), "__after": F.lit(0).cast("long")})
    while True:
        still = (F.col("__size") > 0) & (F.col("__size") <= F.col("__left")) & (F.col("__pos") > F.col("__after"))
        open_items = materialise(wide.join(left, keys).filter(still).drop("__after"), "open")
        n = cut(open_items.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
        if n.isEmpty():
            break
        few, many = n.filter(F.col("__n") <= window), n.filter(F.col("__n") > window)
        kept = kept.unionByName(_folded(open_items.join(few, keys, "left_semi"), keys))
        if many.isEmpty():
            break
        power = F.pow(F.lit(2.0), F.floor(F.log2("__left"))).cast("long")
        state = open_items.join(many, keys, "left_semi").withColumn("__t", power)
        state = state.withColumn("__small", F.when(F.col("__size") < F.col("__t"), F.col("__size")).otherwise(F.lit(0)))
        state = materialise(scan(state, keys, "__pos", total={"__s": "__small"}), "totals")
        rest = F.col("__left") - F.col("__s")
        ends = F.when(F.col("__size") < F.col("__t"), rest < F.col("__t")).otherwise(F.col("__size") <= rest)
        over = F.when(F.col("__small") > 0, rest).otherwise(rest - F.col("__size"))
        stop = state.filter(ends).groupBy(*keys).agg(F.min("__pos").alias("__stop"), F.min_by(over, "__pos").alias("__over"))
        stop = cut(stop)
        mine = state.join(stop, keys, "left")
        small = (F.col("__small") > 0) & (F.col("__stop").isNull() | (F.col("__pos") <= F.col("__stop")))
        kept = kept.unionByName(mine.filter(small | (F.col("__pos") == F.col("__stop"))).select(*keys, "__pos"))
        left = stop.select(*keys, F.col("__over").alias("__left"), F.col("__stop").alias("__after"))
    flag = kept.withColumn("kept", F.lit(True))
    return items.join(flag, [*keys, "__pos"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))).drop("__pos")


def _folded(items: DataFrame, keys: list[str]) -> DataFrame:
    """Positions kept of keys with few items: one array a key."""
    xs = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__size"))).alias("xs"), F.first("__left").alias("__left"))
    start = F.struct(F.col("__left").alias("left"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        fits = x["__size"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["__size"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["kept"], F.array(x["__pos"]))).otherwise(acc["kept"]).alias("kept"),
        )

    return xs.select(*keys, F.explode(F.aggregate("xs", start, step)["kept"]).alias("__pos"))
