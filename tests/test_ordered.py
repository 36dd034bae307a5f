"""Ordered operators against plain Python, with spans so small that every row of a hot key crosses them."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import ordered, steps, trees
from runlens.operators.ordered import islands, scan, value_before_run
from runlens.session import materialise


def hot_rows(n=400, seed=1):
    """A third of the rows belong to one key; one key has a single row; some values are missing."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = None if i == 7 else ("hot" if i % 3 == 0 else f"k{r.randrange(9)}")
        rows.append((key, i, r.choice([None, 1, 2, 3]), r.choice("aab")))
    rows.append(("single", n, 5, "a"))
    r.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("span", [3, 50, 100000])
def test_scan(spark, span):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, seq long, v long, tag string")
    got = ordered.scan(
        df, ["key"], "seq", row_number="rn", lag={"prev": "v"}, lead={"next": "tag"}, total={"sum": "v"}, last={"seen": "v"}, span=span
    ).collect()
    want = {}
    for group in by_key(rows).values():
        total, seen = 0, None
        for i, (_, seq, v, _tag) in enumerate(group):
            total += v or 0
            seen = v if v is not None else seen
            want[seq] = (i + 1, group[i - 1][2] if i else None, group[i + 1][3] if i + 1 < len(group) else None, total, seen)
    assert len(got) == len(rows)
    assert {g.seq: (g.rn, g.prev, g.next, g["sum"], g.seen) for g in got} == want


@pytest.mark.parametrize("span", [3, 100000])
def test_islands(spark, span):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, seq long, v long, tag string")
    got = {r.seq: r.part for r in ordered.islands(df, ["key"], "seq", ["tag"], "part", span=span, breaks=F.col("v") == 3).collect()}
    want = {}
    for group in by_key(rows).values():
        n, prev = 0, object()
        for _, seq, v, tag in group:
            n += tag != prev or v == 3
            prev = tag
            want[seq] = n
    assert got == want


@pytest.mark.parametrize("span", [1, 3, 100000])
def test_value_before_run(spark, span):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, seq long, v long, tag string")
    got = {r.seq: r.before for r in ordered.value_before_run(df, ["key"], "seq", "tag", "before", span).collect()}
    want = {}
    for group in by_key(rows).values():
        before = prev = None
        for _, seq, _, tag in group:
            before = prev if prev is not None and prev != tag else before
            want[seq] = before
            prev = tag
    assert got == want


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "key string, seq long, v long")
    assert ordered.scan(df, ["key"], "seq", row_number="rn", total={"s": "v"}).collect() == []


def test_first_k_keeps_ties_apart(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [(None, 3)], "key string, seq long")
    got = sorted((r.key or "", r.seq, r.rk) for r in ordered.first_k(df, ["key"], ["seq"], 3, "rk").collect())
    assert got == [("", 3, 1), ("a", 0, 1), ("a", 1, 2), ("a", 2, 3)]


@pytest.mark.parametrize("span", [5, 100000])
def test_first_disjoint(spark, span):
    r = random.Random(4)
    rows = []
    for run in range(4):
        for start in sorted(r.sample(range(120), 40)):
            rows.append((run, start, None if r.random() < 0.03 else start + r.randrange(1, 25)))
    df = spark.createDataFrame(rows, "run_id long, start long, stop long")
    got = {(x.run_id, x.start) for x in steps.first_disjoint(df, ["run_id"], "start", "stop", span).collect()}
    want = set()
    for run in range(4):
        at = -1
        for _, start, stop in sorted((x for x in rows if x[0] == run), key=lambda x: x[1]):
            if at is not None and start >= at:
                want.add((run, start))
                at = stop
    assert got == want


def test_tree_paths(spark):
    r = random.Random(2)
    parent = {(run, n): (r.randrange(1, n) if n > 1 else None) for run in range(3) for n in range(1, 60)}
    parent.update({(9, n): n - 1 if n > 1 else None for n in range(1, 40)})  # a chain
    df = spark.createDataFrame([(a, n, p) for (a, n), p in parent.items()], "run_id long, node long, parent long")
    paths = trees.tree_paths(df, ["run_id"], "node", "parent")
    for row in paths.collect():
        chain, at = [], row.node
        while at is not None:
            chain.insert(0, at)
            at = parent[(row.run_id, at)]
        assert [x.node for x in row.path] == chain and row.depth == len(chain) - 1
    up = trees.ancestors(paths, ["run_id"], "node").filter("run_id = 9 and node = 39")
    assert up.count() == 38 and up.agg(F.max("distance")).first()[0] == 38


@pytest.mark.parametrize("window", [2, 5, 4096])
def test_fit_budget(spark, window):
    r = random.Random(3)
    rows = [(g, i, r.choice([0, 1, 5, 9, 30, 70, 200])) for g in "abc" for i in range(40)]
    df = spark.createDataFrame(rows, "g string, pos long, size long")
    got = {(x.g, x.pos): x.kept for x in trees.fit_budget(df, ["g"], ["pos"], "size", 100, window).collect()}
    want = {}
    for g in "abc":
        left = 100
        for _, pos, size in sorted(x for x in rows if x[0] == g):
            want[(g, pos)] = size <= left
            left -= size if size <= left else 0
    assert got == want


def test_walk_order_is_depth_first(spark):
    r = random.Random(5)
    sites = [(run, src, pos, r.randrange(7)) for run in range(6) for src in range(7) for pos in range(3)]
    df = spark.createDataFrame(sites, "run long, src long, pos long, dst long")
    entry = spark.createDataFrame([(run, 0) for run in range(6)], "run long, fn long")
    got = {}
    for row in trees.walk_order(df, entry, "run").collect():
        got.setdefault(row.run, []).append((row.path, row.fn))
    for run in range(6):
        order, seen = [], set()

        def visit(fn):
            seen.add(fn)
            order.append(fn)
            for _, _, _, dst in sorted(x for x in sites if x[0] == run and x[1] == fn):
                if dst not in seen:
                    visit(dst)

        visit(0)
        assert [fn for _, fn in sorted(got[run])] == order


def test_reach_stops_at_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(10)] + [("n3", "n1")], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "v string")
    assert {r.v: r.depth for r in trees.reach(edges, start, 5).collect()} == {f"n{i}": i for i in range(5)}
    assert trees.reach(edges, start).count() == 11


def test_rows_are_shuffled_once_for_a_scan(spark):
    rows = materialise(spark.createDataFrame([(1, 1), (1, 5000), (None, 2), (None, 3), (None, 9000), (2, None)], "k long, o long"), "once")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (
            scan(rows, ["k"], "o", row_number="n", last={"v": "o"}, settled=True),
            islands(rows, ["k"], "o", ["k"], "n", settled=True),
            value_before_run(rows, ["k"], "o", "o", "n", settled=True),
        ):
            # the rows, the sums of the spans by span and by key, and what is carried
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
            assert out.count() == 6
        numbered = scan(rows, ["k"], "o", row_number="n", settled=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert {(r.k, r.o, r.n) for r in numbered} == {(1, 1, 1), (1, 5000, 2), (None, 2, 1), (None, 3, 2), (None, 9000, 3), (2, None, 1)}
