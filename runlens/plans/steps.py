"""Steps of a run: mapping, merging, branches, loops, groups, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls, steps, trees
from ..operators.ordered import scan
from . import feeds
from .feeds import spark_feed
from .registry import query
from .stepsql import with_steps

RUN = ["run_id"]


def lines(t):
    return t.once("lines", lambda: spark_feed(t, feeds.LINES))


def stmts(t):
    return t.once("statements", lambda: spark_feed(t, feeds.STATEMENTS))


def nodes(t):
    return spark_feed(t, feeds.NODES)


def closure(t):
    return t.once("closure", lambda: trees.block_ancestors(stmts(t), RUN))


def tagged(t):
    return t.once("tagged", lambda: steps.tag_islands(steps.map_lines(lines(t), stmts(t))))


def occurred(t):
    dims = stmts(t).select("run_id", "stmt", "kind", "parent", "block", "grp", "line", "last_line", "call_origin")
    return steps.with_occurrence(steps.merge_events(tagged(t))).join(dims, ["run_id", "stmt"])


def kept(t, c=None):
    return t.once("kept", lambda: steps.drop_tails(occurred(t), closure(t) if c is None else c))


def paths(t):
    return t.once("paths", lambda: trees.tree_paths(nodes(t), RUN, "node", "parent"))


@query("jn2_line_statement", with_steps("SELECT run_id, seq, file, line, stmt FROM mp"))
def _(t):
    return steps.map_lines(spark_feed(t, feeds.LINES), spark_feed(t, feeds.STATEMENTS)).select("run_id", "seq", "file", "line", "stmt")


@query("win5_islands", with_steps("SELECT run_id, seq, island, node, stmt FROM isl"))
def _(t):
    return tagged(t).select("run_id", "seq", "island", "node", "stmt")


@query(
    "agg22_merged_events",
    with_steps(
        """SELECT mg.run_id, mg.seq, end_seq, mg.node, mg.stmt, mg.t_ms, mg.raised, c.var, c.value FROM mg JOIN
           (SELECT run_id, island, var, arg_max(value, seq) AS value FROM isl GROUP BY ALL) c USING (run_id, island)"""
    ),
)
def _(t):
    x = tagged(t)
    both = steps.merge_events(x).join(steps.latest_changes(x), ["run_id", "island"])
    return both.select("run_id", "seq", "end_seq", "node", "stmt", "t_ms", "raised", "var", "value")


@query("win6_occurrence", with_steps("SELECT run_id, seq, node, stmt, occurrence FROM oc"))
def _(t):
    return occurred(t).select("run_id", "seq", "node", "stmt", "occurrence")


@query("gr5_block_ancestors", with_steps("SELECT run_id, stmt, ancestor, side FROM anc"))
def _(t):
    return closure(t)


@query("win7_drop_tails", with_steps("SELECT run_id, seq, node, stmt, kind FROM kp"))
def _(t):
    return kept(t).select("run_id", "seq", "node", "stmt", "kind")


@query("win8_next_time", with_steps("SELECT run_id, seq, node, t_ms, t_end FROM tm"))
def _(t):
    return steps.with_next_time(kept(t), nodes(t)).select("run_id", "seq", "node", "t_ms", "t_end")


@query(
    "jn3_interval",
    with_steps(
        """SELECT tm.run_id, tm.node, tm.seq, io.event_id AS fact FROM tm JOIN io ON io.run_id = tm.run_id AND io.node = tm.node
           AND io.t_ms BETWEEN tm.t_ms AND tm.t_end"""
    ),
)
def _(t):
    facts = spark_feed(t, feeds.IO).select("run_id", "node", "t_ms", F.col("event_id").alias("fact"))
    return steps.during(steps.with_next_time(kept(t), nodes(t)), facts)


_FOCUS = "(fn = 'main:<module>' OR fn IN ('m0:view', 'm1:click', 'm2:error', 'm3:purchase'))"


@query(
    "jn4_unfocused_calls",
    with_steps(
        f"""SELECT tm.run_id, tm.node, tm.seq, c.node AS fact, c.fn, count(*) OVER (PARTITION BY tm.run_id, tm.node, tm.seq) AS calls
           FROM tm JOIN nd c ON c.run_id = tm.run_id AND c.parent = tm.node AND NOT {_FOCUS}
           AND c.t_ms BETWEEN tm.t_ms AND tm.t_end"""
    ),
)
def _(t):
    away = nodes(t).filter(f"NOT {_FOCUS}").select("run_id", F.col("node").alias("fact"), F.col("parent").alias("node"), "t_ms", "fn")
    hit = steps.during(steps.with_next_time(kept(t), nodes(t)), away)
    per = hit.groupBy("run_id", "node", "seq").agg(F.count(F.lit(1)).alias("calls"))
    return hit.join(away.select("run_id", "fact", "fn"), ["run_id", "fact"]).join(per, ["run_id", "node", "seq"]).select(
        "run_id", "node", "seq", "fact", "fn", "calls"
    )


# the first call of a function under a call is kept in detail, the others are counted
_ONCE = """
wr AS (SELECT *, row_number() OVER (PARTITION BY run_id, parent, fn ORDER BY node) AS rn, count(*) OVER (PARTITION BY run_id, parent, fn) AS total FROM nd),
dt(run_id, node) AS (SELECT run_id, node FROM wr WHERE parent IS NULL AND rn = 1 UNION ALL SELECT w.run_id, w.node FROM wr w JOIN dt ON dt.run_id = w.run_id AND dt.node = w.parent WHERE w.rn = 1)"""


@query(
    "jn4_repeats",
    with_steps(
        f"""SELECT tm.run_id, tm.node, tm.seq, c.node AS fact, c.fn, CASE WHEN c.total > 1 THEN c.total - 1 END AS repeats
           FROM tm JOIN wr c ON c.run_id = tm.run_id AND c.parent = tm.node AND NOT {_FOCUS}
           AND c.t_ms BETWEEN tm.t_ms AND tm.t_end JOIN dt ON dt.run_id = c.run_id AND dt.node = c.node""",
        _ONCE,
    ),
)
def _(t):
    """Calls out of the focus made while a statement ran, with how often the calling call made more of them."""
    all_calls = nodes(t).select("run_id", "node", "parent", "fn", "t_ms")
    detailed = t.once("detailed", lambda: calls.detailed_calls(all_calls, 1))
    more = calls.repeats(all_calls, detailed, 1).withColumnRenamed("parent", "node")
    away = detailed.filter(f"NOT {_FOCUS}").select("run_id", F.col("node").alias("fact"), F.col("parent").alias("node"), "t_ms", "fn")
    hit = steps.during(steps.with_next_time(kept(t), nodes(t)), away.drop("fn"))
    return hit.join(away.select("run_id", "fact", "fn"), ["run_id", "fact"]).join(more, ["run_id", "node", "fn"], "left")


_ROWS = """
mv AS (SELECT run_id, seq, node, lag(node) OVER w AS prev, lead(seq) OVER w AS nxt FROM kp WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
df AS (SELECT mv.*, a.path AS a, b.path AS b,
              len(list_filter(list_zip(a.path, b.path), lambda x: x[1] IS NOT DISTINCT FROM x[2])) AS c
       FROM mv JOIN ch a ON a.run_id = mv.run_id AND a.node = mv.prev JOIN ch b ON b.run_id = mv.run_id AND b.node = mv.node
       WHERE prev <> mv.node),
cr AS (
  SELECT run_id, seq AS at_seq, 'return' AS type, unnest(range(len(a) - c)) AS ord, unnest(list_reverse(a[c + 1:])) AS node FROM df
  UNION ALL
  SELECT run_id, seq, 'enter', unnest(range(len(b) - c)), unnest(b[c + 1:]) FROM df
  UNION ALL
  SELECT mv.run_id, seq, 'enter', 0, mv.node FROM mv JOIN ch USING (run_id, node) WHERE prev IS NULL AND len(path) > 1
  UNION ALL
  SELECT mv.run_id, NULL, 'return', unnest(range(len(path) - 1)), unnest(list_reverse(path[2:])) FROM mv JOIN ch USING (run_id, node) WHERE nxt IS NULL)
"""


@query("win12_call_rows", with_steps("SELECT run_id, at_seq, type, ord, node FROM cr", _ROWS))
def _(t):
    return steps.call_rows(kept(t), paths(t))


@query(
    "jn5_call_site",
    with_steps(
        """SELECT run_id, node, at_seq, site FROM (
             SELECT cr.run_id, cr.node, cr.at_seq, kp.seq AS site, row_number() OVER (PARTITION BY cr.run_id, cr.node, cr.at_seq
                    ORDER BY list_position(c.path, kp.node) DESC, kp.seq DESC) AS rn
             FROM cr JOIN ch c ON c.run_id = cr.run_id AND c.node = cr.node
                  JOIN kp ON kp.run_id = cr.run_id AND kp.seq < cr.at_seq AND list_contains(c.path, kp.node) AND kp.node <> cr.node
             WHERE cr.type = 'enter') x WHERE rn = 1""",
        _ROWS,
    ),
)
def _(t):
    p, k = paths(t), kept(t)
    enter = steps.call_rows(k, p).filter("type = 'enter'").select("run_id", "node", "at_seq")
    up = trees.ancestors(p, RUN, "node").select("run_id", "node", "ancestor", "distance")
    return steps.call_site(enter, k.select("run_id", "node", "seq"), up)


_RET = """
rt AS (SELECT cr.*, coalesce(at_seq, 1000000) AS lim FROM cr WHERE type = 'return'),
rs AS (SELECT * FROM (SELECT rt.run_id, rt.node, rt.at_seq, rt.ord, kp.seq AS site, row_number() OVER (PARTITION BY rt.run_id, rt.node, rt.at_seq
         ORDER BY list_position(c.path, kp.node) DESC, kp.seq DESC) AS rn
       FROM rt JOIN ch c ON c.run_id = rt.run_id AND c.node = rt.node
            JOIN kp ON kp.run_id = rt.run_id AND kp.seq < rt.lim AND list_contains(c.path, kp.node) AND kp.node <> rt.node) WHERE rn = 1)
"""


@query(
    "win13_changes_on_return",
    with_steps(
        """SELECT run_id, site, arg_max(node, at_seq * 1000 + ord) AS shown_on, max(at_seq) AS at_seq FROM rs WHERE at_seq IS NOT NULL GROUP BY run_id, site""",
        _ROWS + "," + _RET,
    ),
)
def _(t):
    p, k = paths(t), kept(t)
    rets = steps.call_rows(k, p).filter("type = 'return' AND at_seq IS NOT NULL")
    up = trees.ancestors(p, RUN, "node").select("run_id", "node", "ancestor", "distance")
    site = steps.call_site(rets.select("run_id", "node", "at_seq"), k.select("run_id", "node", "seq"), up)
    # the changes of a calling statement are shown on its last return
    return rets.join(site, ["run_id", "node", "at_seq"]).groupBy("run_id", "site").agg(
        F.max_by("node", F.struct("at_seq", "ord")).alias("shown_on"), F.max("at_seq").alias("at_seq")
    )


@query(
    "win10_branch",
    with_steps(
        """SELECT x.run_id, x.node, x.seq, x.stmt, coalesce(a.side, 'none') AS taken FROM
           (SELECT *, lead(stmt) OVER (PARTITION BY run_id, node ORDER BY seq) AS nxt FROM kp) x
           LEFT JOIN anc a ON a.run_id = x.run_id AND a.stmt = x.nxt AND a.ancestor = x.stmt WHERE kind IN ('if', 'match')"""
    ),
)
def _(t):
    c = closure(t)
    return steps.branch_taken(kept(t, c), c)


_LOOPS = """
hd AS (SELECT run_id, node, stmt AS loop, seq AS start FROM kp WHERE kind IN ('for', 'while') AND occurrence = 1),
cnt AS (SELECT run_id, node, line, count(*) AS n FROM ln GROUP BY ALL),
bl AS (SELECT run_id, parent AS loop, arg_min(line, ord) AS line FROM stt WHERE block = 'body' GROUP BY ALL),
lt AS (SELECT hd.run_id, hd.node, hd.loop, hd.start,
         min(k.seq) FILTER (WHERE k.stmt <> hd.loop AND a.side IS NULL) AS stop,
         min(k.seq) FILTER (WHERE k.stmt = hd.loop) AS sec
       FROM hd LEFT JOIN kp k ON k.run_id = hd.run_id AND k.node = hd.node AND k.seq > hd.start
            LEFT JOIN anc a ON a.run_id = k.run_id AND a.stmt = k.stmt AND a.ancestor = hd.loop GROUP BY ALL),
ls AS (SELECT lt.run_id, lt.node, lt.loop, start, stop, CASE WHEN stop IS NULL OR sec < stop THEN sec END AS second,
              coalesce(n, 0) AS iterations
       FROM lt LEFT JOIN bl ON bl.run_id = lt.run_id AND bl.loop = lt.loop
            LEFT JOIN cnt ON cnt.run_id = lt.run_id AND cnt.node = lt.node AND cnt.line = bl.line),
cs AS (SELECT * FROM ls WHERE iterations > 3 AND second IS NOT NULL),
tk(run_id, start, stop) AS (
  SELECT run_id, min(start), arg_min(coalesce(stop, 1000000), start) FROM cs GROUP BY run_id
  UNION ALL
  SELECT run_id, start, stop FROM (SELECT cs.run_id, cs.start, coalesce(cs.stop, 1000000) AS stop,
      row_number() OVER (PARTITION BY cs.run_id ORDER BY cs.start) AS rn FROM tk JOIN cs ON cs.run_id = tk.run_id AND cs.start >= tk.stop) WHERE rn = 1),
hid AS (SELECT kp.run_id, kp.seq, cs.start AS hidden_by FROM kp JOIN cs ON cs.run_id = kp.run_id AND kp.seq >= cs.second AND
        kp.seq < coalesce(cs.stop, 1000000) JOIN tk ON tk.run_id = cs.run_id AND tk.start = cs.start)
"""


def loops(t, k, c):
    counts = lines(t).groupBy("run_id", "node", "line").agg(F.count(F.lit(1)).alias("n"))
    return steps.loop_spans(k, c, stmts(t), counts)


@query("win11_loop_spans", with_steps("SELECT * FROM ls", _LOOPS))
def _(t):
    c = closure(t)
    return loops(t, kept(t, c), c)


@query("win11_loop_collapse", with_steps("SELECT run_id, seq, hidden_by FROM hid", _LOOPS))
def _(t):
    c = closure(t)
    k = kept(t, c)
    return steps.hidden_by_loops(k, loops(t, k, c))


@query(
    "agg14_loop_effect",
    with_steps(
        """SELECT run_id, hidden_by, var, value FROM (SELECT h.run_id, hidden_by, var, arg_max(value, c.seq) AS value, arg_max(value < 5, c.seq) AS del
           FROM hid h JOIN (SELECT m.run_id, m.seq, i.var, arg_max(i.value, i.seq) AS value FROM mg m JOIN isl i USING (run_id, island) GROUP BY ALL) c
           ON c.run_id = h.run_id AND c.seq = h.seq GROUP BY ALL) WHERE NOT del""",
        _LOOPS,
    ),
)
def _(t):
    c = closure(t)
    k = kept(t, c)
    hidden = steps.hidden_by_loops(k, loops(t, k, c))
    x = tagged(t)
    changes = steps.merge_events(x).select("run_id", "island", "seq").join(steps.latest_changes(x), ["run_id", "island"])
    # a value below five stands for a deleted variable
    return steps.loop_effect(hidden, changes.withColumn("deleted", F.col("value") < 5))


@query(
    "win11_loop_summaries",
    with_steps(
        """SELECT p.*, v.vars, v.latest FROM (
             SELECT h.run_id, h.hidden_by AS start, any_value(cs.node) AS node, any_value(cs.loop) AS stmt, any_value(cs.iterations) AS iterations,
               (count(*) FILTER (WHERE kp.node = cs.node AND kp.stmt = cs.loop) + 1)::bigint AS detailed, count(*) AS hidden
             FROM hid h JOIN kp ON kp.run_id = h.run_id AND kp.seq = h.seq JOIN cs ON cs.run_id = h.run_id AND cs.start = h.hidden_by GROUP BY h.run_id, h.hidden_by) p
           LEFT JOIN (SELECT run_id, hidden_by, list(var ORDER BY var) AS vars, round(sum(value), 6) AS latest FROM (
             SELECT h.run_id, hidden_by, var, arg_max(value, c.seq) AS value, arg_max(value < 5, c.seq) AS del
             FROM hid h JOIN cs ON cs.run_id = h.run_id AND cs.start = h.hidden_by JOIN kp ON kp.run_id = h.run_id AND kp.seq = h.seq AND kp.node = cs.node
             JOIN (SELECT m.run_id, m.seq, i.var, arg_max(i.value, i.seq) AS value FROM mg m JOIN isl i USING (run_id, island) GROUP BY ALL) c
             ON c.run_id = h.run_id AND c.seq = h.seq GROUP BY ALL) WHERE NOT del GROUP BY ALL) v ON v.run_id = p.run_id AND v.hidden_by = p.start""",
        _LOOPS,
    ),
)
def _(t):
    c = closure(t)
    k = kept(t, c)
    spans = t.once("spans", lambda: loops(t, k, c))
    x = tagged(t)
    changes = steps.merge_events(x).select("run_id", "island", "seq").join(steps.latest_changes(x), ["run_id", "island"])
    found = steps.loop_summaries(spans, steps.hidden_by_loops(k, spans), k, changes.withColumn("deleted", F.col("value") < 5))
    total = F.aggregate(F.map_values("changes"), F.lit(0.0), lambda a, v: a + v)
    return found.select(
        "run_id", "start", "node", "stmt", "iterations", "detailed", "hidden", F.array_sort(F.map_keys("changes")).alias("vars"), F.round(total, 6).alias("latest")
    )


_GROUPS = """
g1 AS (SELECT *, CASE WHEN grp IS NOT NULL AND raised IS NULL AND lag(node) OVER w = node AND lag(grp) OVER w = grp
                      AND lag(parent) OVER w IS NOT DISTINCT FROM parent THEN 0 ELSE 1 END AS brk
       FROM kp WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
g2 AS (SELECT *, sum(brk) OVER (PARTITION BY run_id ORDER BY seq) AS g FROM g1),
gs AS (SELECT run_id, g, node, min(seq) AS seq, CASE WHEN count(*) > 1 THEN 'group' ELSE 'statement' END AS type,
              list(stmt ORDER BY seq) AS stmts, arg_min(line, seq) AS first_line, max(last_line) AS last_line FROM g2 GROUP BY run_id, g, node)
"""


@query("win9_groups", with_steps("SELECT run_id, node, seq, type, stmts, first_line, last_line FROM gs", _GROUPS))
def _(t):
    return steps.group_steps(kept(t))


@query("agg16_group_sizes", with_steps("SELECT type, len(stmts) AS n, count(*) AS steps, min(first_line) AS first_line, max(last_line) AS last_line FROM gs GROUP BY ALL", _GROUPS))
def _(t):
    g = steps.group_steps(kept(t))
    return g.groupBy("type", F.size("stmts").cast("long").alias("n")).agg(
        F.count(F.lit(1)).alias("steps"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")
    )


_SCORE = """
sc AS (SELECT kp.*, max(c.value > 100) AS big, count(c.value) > 0 AS anyc FROM kp LEFT JOIN isl c ON c.run_id = kp.run_id AND c.island = kp.island GROUP BY ALL),
sv AS (SELECT run_id, seq, stmt, CASE WHEN kind IN ('import', 'constant', 'pass', 'scope') THEN 1 WHEN raised IS NOT NULL THEN 6 ELSE
         greatest(1, CASE WHEN kind IN ('if', 'while', 'match') THEN 4 ELSE 1 END, CASE WHEN kind IN ('for', 'while', 'return') THEN 3 ELSE 1 END,
                  CASE WHEN call_origin = 'project' THEN 4 ELSE 1 END, CASE WHEN big THEN 5 WHEN anyc THEN 2 ELSE 1 END) END::bigint AS score FROM sc),
rk AS (SELECT run_id, stmt, max(score) AS score, min(seq) AS first FROM sv GROUP BY ALL)
"""


def scored(t):
    per = tagged(t).groupBy("run_id", "island").agg(
        F.max(F.col("value") > 100).alias("changes_table"), (F.count("value") > 0).alias("changes_any")
    )
    k = kept(t).join(per, ["run_id", "island"], "left")
    return k.withColumns({"calls_project": F.col("call_origin") == "project", "does_io": F.lit(False)})


@query("win14_step_score", with_steps("SELECT run_id, seq, stmt, score FROM sv", _SCORE))
def _(t):
    return scored(t).select("run_id", "seq", "stmt", steps.step_score().alias("score"))


@query("agg15_importance", with_steps("SELECT * FROM rk", _SCORE))
def _(t):
    return steps.importance(scored(t))


@query(
    "top3_statements",
    with_steps("SELECT run_id, stmt, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, first) AS place FROM rk QUALIFY place <= 20", _SCORE),
)
def _(t):
    top = steps.top_statements(steps.importance(scored(t)), 20)
    return top.select("run_id", "stmt", F.col("place").cast("long").alias("place"))


@query(
    "win17_step_ids",
    with_steps("SELECT run_id, seq, concat('s', row_number() OVER (PARTITION BY run_id ORDER BY seq)) AS step FROM kp"),
)
def _(t):
    numbered = scan(kept(t).select("run_id", "seq"), RUN, "seq", row_number="n")
    return numbered.select("run_id", "seq", F.concat(F.lit("s"), F.col("n")).alias("step"))


@query(
    "jn9_links",
    with_steps(
        """SELECT h.run_id, a.step, b.step AS hidden_by FROM hid h
           JOIN (SELECT run_id, seq, concat('s', row_number() OVER (PARTITION BY run_id ORDER BY seq)) AS step FROM kp) a USING (run_id, seq)
           JOIN (SELECT run_id, seq, concat('s', row_number() OVER (PARTITION BY run_id ORDER BY seq)) AS step FROM kp) b
             ON b.run_id = h.run_id AND b.seq = h.hidden_by""",
        _LOOPS,
    ),
)
def _(t):
    c = closure(t)
    k = kept(t, c)
    hidden = steps.hidden_by_loops(k, loops(t, k, c))
    ids = scan(k.select("run_id", "seq"), RUN, "seq", row_number="n").select("run_id", "seq", F.concat(F.lit("s"), F.col("n")).alias("step"))
    target = ids.select("run_id", F.col("seq").alias("hidden_by"), F.col("step").alias("__to"))
    return hidden.join(ids, ["run_id", "seq"]).join(target, ["run_id", "hidden_by"], "left").select(
        "run_id", "step", F.col("__to").alias("hidden_by")
    )


@query(
    "agg13_step_counts",
    with_steps(
        """SELECT kp.run_id, count(*) AS steps, count(*) FILTER (WHERE h.seq IS NULL) AS visible, count(DISTINCT stmt) AS statements
           FROM kp LEFT JOIN hid h ON h.run_id = kp.run_id AND h.seq = kp.seq GROUP BY 1""",
        _LOOPS,
    ),
)
def _(t):
    c = closure(t)
    k = kept(t, c)
    hidden = steps.hidden_by_loops(k, loops(t, k, c))
    both = k.select("run_id", "seq", "stmt").join(hidden, ["run_id", "seq"], "left")
    return both.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("hidden_by").isNull()).alias("visible"),
        F.countDistinct("stmt").alias("statements"),
    )


# snapshots of the variables of a call: an order is a call, a line number a snapshot
_SNAP = """SELECT l_orderkey AS call, cast(l_linenumber AS bigint) AS snap, concat(l_returnflag, l_linestatus) AS var,
           max(l_partkey % 2) AS fingerprint FROM {lineitem} GROUP BY 1, 2, 3"""


@query(
    "win15_snapshot_changes",
    f"""WITH s AS {feeds.oracle_feed(_SNAP)}, n AS (SELECT call, max(snap) AS last FROM s GROUP BY 1)
        SELECT coalesce(a.call, b.call) AS call, coalesce(a.snap, b.snap + 1) AS snap, coalesce(a.var, b.var) AS var,
               CASE WHEN a.call IS NULL THEN 'deleted' WHEN b.call IS NULL THEN 'new' ELSE 'changed' END AS change
        FROM s a FULL JOIN s b ON a.call = b.call AND a.var = b.var AND a.snap = b.snap + 1
        JOIN n ON n.call = coalesce(a.call, b.call)
        WHERE (a.fingerprint IS DISTINCT FROM b.fingerprint) AND coalesce(a.snap, b.snap + 1) <= n.last""",
)
def _(t):
    return steps.snapshot_changes(spark_feed(t, _SNAP), ["call"])


@query(
    "prd12_used_variables",
    with_steps(
        """SELECT isl.run_id, isl.seq, isl.var FROM isl JOIN stt USING (run_id, stmt)
           WHERE kind NOT IN ('import', 'def', 'class') AND list_contains([lower(call_origin), 'view', CASE WHEN kind = 'assign' THEN 'click' END, 'error'], isl.var)"""
    ),
)
def _(t):
    # names a statement reads, writes or mutates
    used = F.array_union(
        F.array(F.lower("call_origin"), F.lit("view")), F.array(F.when(F.col("kind") == "assign", "click"), F.lit("error"))
    )
    dims = stmts(t).select("run_id", "stmt", "kind", used.alias("used"))
    ev = tagged(t).select("run_id", "seq", "stmt", F.create_map("var", "value").alias("changes")).join(dims, ["run_id", "stmt"])
    ev = ev.withColumn("changes", F.map_filter("changes", lambda k, v: F.array_contains(F.col("used"), k)))
    return ev.filter((F.size("changes") > 0) & ~F.col("kind").isin("import", "def", "class")).select("run_id", "seq", F.explode(F.map_keys("changes")).alias("var"))


@query(
    "jn19_mutated_names",
    with_steps(
        """SELECT mp.run_id, mp.seq, m AS name, mp.var = m AS in_changes FROM mp JOIN stt USING (run_id, stmt),
           unnest(CASE WHEN kind = 'assign' THEN ['view', 'rows'] WHEN kind = 'expr' THEN ['rows'] ELSE [] END) AS u(m)"""
    ),
)
def _(t):
    mutates = F.expr("CASE WHEN kind = 'assign' THEN array('view', 'rows') WHEN kind = 'expr' THEN array('rows') ELSE array() END")
    dims = stmts(t).select("run_id", "stmt", F.explode(mutates).alias("name"))
    ev = steps.map_lines(lines(t), stmts(t))
    return ev.join(dims, ["run_id", "stmt"]).select("run_id", "seq", "name", (F.col("var") == F.col("name")).alias("in_changes"))
