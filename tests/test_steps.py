"""Step operators on a small hand-made recording, against plain Python."""

import random

from pyspark.sql import functions as F

from runlens.operators import steps, trees

# one file: a loop of two statements, an if with a body, a with block, a closing statement
STMTS = [
    (1, "a:1", "a", 1, 1, 0, "for", None, None, None),
    (1, "a:2", "a", 2, 2, 1, "assign", "a:1", "body", "assign"),
    (1, "a:3", "a", 3, 4, 2, "expr", "a:1", "body", None),
    (1, "a:5", "a", 5, 5, 3, "if", None, None, None),
    (1, "a:6", "a", 6, 6, 4, "assign", "a:5", "body", "assign"),
    (1, "a:7", "a", 7, 7, 5, "with", None, None, None),
    (1, "a:8", "a", 8, 8, 6, "assign", "a:7", "body", "assign"),
    (1, "a:9", "a", 9, 9, 7, "assign", None, None, "assign"),
]
COLS = "run_id long, stmt string, file string, line long, last_line long, ord long, kind string, parent string, block string, grp string"


def recording(spark, iterations):
    """Lines of one call: the loop, its final check, the untaken if, the with block and its exit, the end."""
    order = []
    for _ in range(iterations):
        order += [1, 2, 3, 4]
    order += [1, 5, 7, 8, 7, 9]
    lines = [(1, i + 1, 1, "a", n, float(i), f"v{n}", float(i), None) for i, n in enumerate(order)]
    df = spark.createDataFrame(lines, "run_id long, seq long, node long, file string, line long, t_ms double, var string, value double, raised string")
    return df, spark.createDataFrame(STMTS, COLS)


def kept(spark, iterations):
    lines, stmts = recording(spark, iterations)
    closure = trees.block_ancestors(stmts, ["run_id"])
    merged = steps.merge_events(steps.tag_islands(steps.map_lines(lines, stmts), span=4))
    events = steps.with_occurrence(merged, span=4).join(stmts.drop("file", "ord"), ["run_id", "stmt"])
    return lines, stmts, closure, steps.drop_tails(events, closure, span=4)


def test_ends_of_blocks_are_no_steps(spark):
    _, _, closure, k = kept(spark, 3)
    got = [r.stmt for r in k.orderBy("seq").collect()]
    # the final check of the loop and the exit of the with block are gone; the two lines of a:3 are one event
    assert got == ["a:1", "a:2", "a:3"] * 3 + ["a:5", "a:7", "a:8", "a:9"]
    assert [(r.stmt, r.taken) for r in steps.branch_taken(k, closure).collect()] == [("a:5", "none")]


def test_short_loop_is_shown_in_full(spark):
    lines, stmts, closure, k = kept(spark, 3)
    counts = lines.groupBy("run_id", "node", "line").agg(F.count(F.lit(1)).alias("n"))
    spans = steps.loop_spans(k, closure, stmts, counts)
    assert [(r.loop, r.iterations) for r in spans.collect()] == [("a:1", 3)]
    assert steps.hidden_by_loops(k, spans).isEmpty()


def test_long_loop_collapses(spark):
    lines, stmts, closure, k = kept(spark, 20)
    counts = lines.groupBy("run_id", "node", "line").agg(F.count(F.lit(1)).alias("n"))
    spans = steps.loop_spans(k, closure, stmts, counts)
    row = spans.first()
    assert (row.loop, row.iterations, row.start, row.second) == ("a:1", 20, 1, 5)
    hidden = steps.hidden_by_loops(k, spans, span=8)
    assert hidden.count() == 19 * 3 and {r.hidden_by for r in hidden.collect()} == {1}
    changes = k.select("run_id", "seq", F.concat(F.lit("v"), "line").alias("var"), F.col("t_ms").alias("value")).withColumn("deleted", F.col("var") == "v2")
    assert {r["var"] for r in steps.loop_effect(hidden, changes).collect()} == {"v1", "v3"}


def test_neighbours_of_one_group_merge(spark):
    _, _, _, k = kept(spark, 1)
    got = [(r.type, r.stmts) for r in steps.group_steps(k).orderBy("seq").collect()]
    # a:8 and a:9 share the group but not the block
    assert got == [("statement", [s]) for s in ["a:1", "a:2", "a:3", "a:5", "a:7", "a:8", "a:9"]]


def test_during_is_closed_on_both_sides(spark):
    r = random.Random(6)
    times = sorted(r.choice(range(40)) for _ in range(60))
    events, end = [], {1: 40.0, 2: 3.0}
    for node in (1, 2):
        for i, t in enumerate(times):
            nxt = float(times[i + 1]) if i + 1 < len(times) else end[node]
            events.append((1, node, i, float(t), nxt))
    facts = [(1, 1 + i % 2, r.choice(range(45)) + r.choice([0.0, 0.5]), i) for i in range(80)]
    got = steps.during(
        spark.createDataFrame(events, "run_id long, node long, seq long, t_ms double, t_end double"),
        spark.createDataFrame(facts, "run_id long, node long, t_ms double, fact long"),
        span_ms=4.0,
    )
    want = sorted((n, s, f) for _, n, s, t0, t1 in events for _, m, t, f in facts if n == m and t0 <= t <= t1)
    assert sorted((x.node, x.seq, x.fact) for x in got.collect()) == want


def test_importance_overrides(spark):
    rows = [
        ("import", "KeyError", False, 1), ("assign", "KeyError", False, 6), ("for", None, False, 3), ("while", None, False, 4),
        ("return", None, True, 5), ("constant", None, True, 1), ("assign", None, False, 1),
    ]
    df = spark.createDataFrame(rows, "kind string, raised string, changes_table boolean, want long").withColumns(
        {"calls_project": F.lit(None).cast("boolean"), "does_io": F.lit(False), "changes_any": F.lit(False)}
    )
    for r in df.withColumn("got", steps.step_score()).collect():
        assert r.got == r.want, r


def test_focus_cuts_call_rows(spark):
    paths = trees.tree_paths(spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 3)], "run_id long, node long, parent long"), ["run_id"], "node", "parent")
    events = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 2), (1, 4, 4)], "run_id long, seq long, node long")
    rows = lambda f: [(r.at_seq, r.type, r.node) for r in steps.call_rows(events, paths, f).orderBy(F.col("at_seq").asc_nulls_last(), F.desc("type"), "ord").collect()]
    assert rows(None) == [(2, "enter", 2), (2, "enter", 3), (3, "return", 3), (4, "enter", 3), (4, "enter", 4), (None, "return", 4), (None, "return", 3), (None, "return", 2)]
    some = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "run_id long, node long")
    # the last stack is left up to the first call that is not shown
    assert rows(some) == [(2, "enter", 2), (4, "enter", 4), (None, "return", 4)]
