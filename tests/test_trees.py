"""Folds over ancestors, intervals, reading order, constructors, budgets, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import calls, trees
from runlens.operators.ordered import scan
from runlens.session import scratch_path
from runlens.sinks import writers


def forest(spark, parents):
    return spark.createDataFrame([(g, n, p) for (g, n), p in parents.items()], "g long, n long, p long")


def random_forest():
    r = random.Random(8)
    parents = {(g, n): (r.randrange(1, n) if n > 2 else None) for g in range(4) for n in range(1, 80)}  # two roots each
    parents.update({(9, n): n - 1 if n > 1 else None for n in range(1, 2001)})  # a chain of 2,000
    parents[(3, 500)] = 499  # a parent that is not there
    return parents


def depth(parents, g, n):
    d = 0
    while parents.get((g, n)) is not None and (g, parents[(g, n)]) in parents:
        n, d = parents[(g, n)], d + 1
    return d


def test_intervals(spark):
    parents = random_forest()
    got = {(r.g, r.n): (r["first"], r["last"], r["depth"]) for r in trees.intervals(forest(spark, parents), ["g"], "n", "p", "n").collect()}
    assert set(got) == set(parents) and all(x[2] == depth(parents, g, n) for (g, n), x in got.items())
    for (g, n), p in parents.items():
        if p is not None and (g, p) in parents:
            assert got[(g, p)][0] < got[(g, n)][0] <= got[(g, n)][1] <= got[(g, p)][1]
    for g in range(3):
        # children in order, one after another, nothing between
        own = {n: x for (k, n), x in got.items() if k == g}
        for p in own:
            kids = sorted(n for (k, n), q in parents.items() if k == g and q == p)
            at = own[p][0] + 1
            for n in kids:
                assert own[n][0] == at
                at = own[n][1] + 1
            assert at == own[p][1] + 1
        assert sorted(x[0] for n, x in own.items()) == list(range(79))


def test_holds(spark):
    df = forest(spark, {(1, 1): None, (1, 2): 1, (1, 3): 2, (1, 4): 1})
    lab = trees.intervals(df, ["g"], "n", "p", "n").drop("g", "depth")
    a = lab.toDF("a", "a_first", "a_last")
    b = lab.toDF("b", "b_first", "b_last")
    got = {(r.a, r.b) for r in a.crossJoin(b).filter(trees.holds("a", "b")).collect()}
    assert got == {(n, n) for n in range(1, 5)} | {(1, 2), (1, 3), (1, 4), (2, 3)}


def test_depths_and_cycles(spark):
    parents = random_forest()
    got = {(r.g, r.n): r["depth"] for r in trees.tree_depths(forest(spark, parents), ["g"], "n", "p").collect()}
    assert got == {k: depth(parents, *k) for k in parents}
    ring = {(1, n): n % 7 + 1 for n in range(1, 8)} | {(2, 1): None, (2, 2): 1}
    for cyclic in (ring, {(1, 1): 1}):
        df = forest(spark, cyclic)
        for run in (lambda: trees.tree_depths(df, ["g"], "n", "p"), lambda: trees.tree_paths(df, ["g"], "n", "p"), lambda: trees.intervals(df, ["g"], "n", "p", "n")):
            with pytest.raises(trees.CycleError):
                run()


def test_detailed_calls_need_detailed_ancestors(spark):
    r = random.Random(4)
    rows = [(1, n, r.choice("abc"), r.randrange(max(1, n // 9), n // 5 + 2) if n > 1 else None) for n in range(1, 300)]
    first, kept = {}, set()
    for _, n, fn, p in rows:
        first[(p, fn)] = first.get((p, fn), 0) + 1
        if first[(p, fn)] <= 3 and (p is None or p in kept):
            kept.add(n)
    df = spark.createDataFrame(rows, "run_id long, node long, fn string, parent long")
    assert {r.node for r in calls.detailed_calls(df).collect()} == kept and len(kept) < 290


def test_constructors(spark):
    edges = spark.createDataFrame([("m", "C"), ("C", "wrong"), ("C.__init__", "f"), ("f", "D"), ("D", "wrong")], "src string, dst string")
    classes = spark.createDataFrame([("C",), ("D",)], "v string")
    functions = spark.createDataFrame([("f",), ("C.__init__",), ("wrong",)], "v string")
    typed = trees.through_constructors(edges, classes, functions)
    got = {r.v: r.depth for r in trees.reach(typed, spark.createDataFrame([("m",)], "v string")).collect()}
    assert got == {"m": 0, "C": 1, "C.__init__": 2, "f": 3, "D": 4}


def test_reach_through_many_levels(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(24)] + [(r.randrange(25), r.randrange(200)) for _ in range(60)] + [(i, 7) for i in range(20, 60)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want, level = {0: 0}, [0]
    while level:
        level = sorted({b for a, b in edges if a in level} - set(want))
        want.update(dict.fromkeys(level, max(want.values()) + 1))
    assert {x.v: x.depth for x in trees.reach(df, spark.createDataFrame([(0,)], "v long")).collect()} == want
    assert trees.reach(df, spark.createDataFrame([], "v long")).count() == 0


def test_reading_steps(spark):
    r = random.Random(11)
    sites = []
    for run in range(4):
        for src in range(7):
            for pos in range(5):
                parent = r.choice([None, *range(pos)]) if pos else None
                sites.append((run, src, pos, r.randrange(9), r.choice(["if", "for", "try", "call"]), parent, r.choice(["body", "else"])))
    df = spark.createDataFrame(sites, "run long, src long, pos long, dst long, kind string, parent long, block string")
    entry = spark.createDataFrame([(run, 0) for run in range(4)], "run long, fn long")
    got = trees.reading_steps(df, trees.walk_order(df, entry, "run"), "run").collect()
    want = set()
    for run in range(4):
        by = {(s[1], s[2]): s for s in sites if s[0] == run}
        at, where = 0, {}

        def flags(src, pos):
            possible = repeats = False
            while by[(src, pos)][5] is not None:
                _, _, _, _, _, up, block = by[(src, pos)]
                kind = by[(src, up)][4]
                possible |= kind in ("if", "match") or (kind == "try" and block != "body")
                repeats |= kind in ("for", "while")
                pos = up
            return possible, repeats

        def enter(fn):
            nonlocal at
            where[fn] = at
            at += 1
            for pos in range(5):
                if (fn, pos) not in by:
                    return
                dst, step = by[(fn, pos)][3], at
                at += 1
                fresh = dst not in where
                want.add((run, step, fn, pos, dst, fresh, None if fresh else where[dst], *flags(fn, pos)))
                if fresh:
                    enter(dst)

        enter(0)
    assert {(x.run, x.step, x.src, x.pos, x.dst, x.entered, x.see, x.possible, x.repeats) for x in got} == want and len(got) == len(want)


def test_budget_by_size_class(spark, monkeypatch):
    r = random.Random(2)
    rows = [("hot", i, r.choice([0, 1, 2, 3, 50, 400, 900, 1023, 2000])) for i in range(4000)] + [("b", i, 1023 - i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i long, size long").withColumn("name", F.concat(F.lit("n"), F.lpad("i", 6, "0")))
    rounds = []
    folded = trees._folded
    monkeypatch.setattr(trees, "_folded", lambda *a: rounds.append(1) or folded(*a))
    got = {(x.g, x.i): x.kept for x in trees.fit_budget(df.repartition(7), ["g"], ["name"], "size", 1023, 3).collect()}
    want = {}
    for g in ("hot", "b"):
        left = 1023
        for _, i, size in (x for x in rows if x[0] == g):
            want[(g, i)] = size <= left
            left -= size if size <= left else 0
    assert got == want and len(rounds) <= 11
    assert trees.fit_budget(df.limit(0), ["g"], ["name"], "size", 5).count() == 0


def test_ranges_number_one_sequence(spark):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("word"), (F.col("id") % 10).alias("x")).repartition(5)
    got = scan(df, [], "word", row_number="n", total={"sum": "x"}, lag={"before": "word"}, ranges=True).orderBy("n").collect()
    words = sorted((r.word, r.x) for r in df.collect())
    total = 0
    for i, (r, (word, x)) in enumerate(zip(got, words)):
        total += x
        assert (r.n, r.word, r["sum"], r.before) == (i + 1, word, total, words[i - 1][0] if i else None)
    # no task holds the sequence: spans are the partitions of the range exchange
    dealt = df.repartitionByRange(8, "word").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 5000


def test_a_replaced_table_survives_a_failure(spark, monkeypatch):
    path = scratch_path(spark, "table")
    assert writers.save_table(spark.range(10), path) == 10
    assert writers.save_table(spark.range(5), path) == 5 and spark.read.parquet(path).count() == 15
    assert writers.save_table(spark.range(7), path, full_refresh=True) == 7 and spark.read.parquet(path).count() == 7
    move, n = writers.move, []

    def broken(s, a, b):
        n.append(b)
        if len(n) == 2:
            raise OSError("lost")
        move(s, a, b)

    monkeypatch.setattr(writers, "move", broken)
    with pytest.raises(OSError):
        writers.save_table(spark.range(3), path, full_refresh=True)
    monkeypatch.undo()
    assert writers.save_table(spark.range(2), path) == 2 and spark.read.parquet(path).count() == 9
