"""Trees, reachability, reading order, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

_ND = oracle_feed(feeds.NODES)
_EV = oracle_feed(feeds.EV)

# suppliers and parts as modules that import each other, in both directions
_EDGES = """(SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst FROM lineitem UNION SELECT concat('p', l_partkey), concat('s', l_suppkey) FROM lineitem)"""


@query(
    "gr1_import_closure",
    f"""WITH RECURSIVE e AS {_EDGES}, r(v, depth) USING KEY (v) AS (SELECT 's0', 0::bigint UNION SELECT dst, min(r.depth + 1) FROM r JOIN e ON src = r.v
        WHERE NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.v = dst) GROUP BY dst) SELECT v, depth FROM r""",
)
def _(t):
    li = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    edges = li.unionByName(li.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = t.spark.createDataFrame([("s0",)], "v string")
    return trees.reach(edges, start)


_CG = f"(SELECT DISTINCT concat(p.run_id, '/', p.fn) AS src, concat(n.run_id, '/', n.fn) AS dst FROM {_ND} n JOIN {_ND} p ON p.run_id = n.run_id AND p.node = n.parent)"


@query(
    "gr3_reach_depth",
    f"""WITH RECURSIVE e AS {_CG}, r(v, depth) USING KEY (v) AS (SELECT DISTINCT dst, 0::bigint FROM e WHERE src LIKE '%main:<module>'
        UNION SELECT dst, min(r.depth + 1) FROM r JOIN e ON src = r.v
        WHERE r.depth < 49 AND NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.v = dst) GROUP BY dst),
        b AS (SELECT v, depth FROM r)
        SELECT f.v, depth FROM (SELECT DISTINCT concat(run_id, '/', fn) AS v FROM {_ND} n) f LEFT JOIN b USING (v)""",
)
def _(t):
    n = spark_feed(t, feeds.NODES)
    p = n.select("run_id", F.col("node").alias("parent"), F.col("fn").alias("pfn"))
    edges = n.join(p, ["run_id", "parent"]).select(
        F.concat_ws("/", "run_id", "pfn").alias("src"), F.concat_ws("/", "run_id", "fn").alias("dst")
    )
    start = edges.filter(F.col("src").endswith("main:<module>")).select(F.col("dst").alias("v"))
    reached = trees.reach(edges, start, 50)
    return n.select(F.concat_ws("/", "run_id", "fn").alias("v")).distinct().join(reached, "v", "left")


# calling a sign-up is making an object of a class; some classes have a constructor, which calls something
_TYPED = f"""
SELECT concat(run_id, '/', fn) AS v, fn LIKE '%:signup' AS is_class, run_id, min(node) AS node, max(CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END) = 1 AS has_init
FROM ({feeds.NODES}) n GROUP BY run_id, fn"""
_INIT = f"""
SELECT concat(n.run_id, '/', n.fn, '.__init__') AS src, concat(c.run_id, '/', c.fn) AS dst
FROM ({feeds.NODES}) n JOIN ({feeds.NODES}) c ON c.run_id = n.run_id AND c.parent = n.node WHERE n.fn LIKE '%:signup'"""


@query(
    "gr3_constructors",
    f"""WITH RECURSIVE ty AS {oracle_feed(_TYPED)}, ini AS (SELECT concat(v, '.__init__') AS v FROM ty WHERE is_class AND has_init),
        e AS (SELECT src, dst FROM {_CG} x WHERE src NOT LIKE '%:signup' UNION SELECT i.src, i.dst FROM {oracle_feed(_INIT)} i JOIN ini ON ini.v = i.src
              UNION SELECT v, concat(v, '.__init__') FROM ty WHERE is_class AND has_init),
        r(v, depth) USING KEY (v) AS (SELECT DISTINCT dst, 0::bigint FROM e WHERE src LIKE '%main:<module>'
        UNION SELECT dst, min(r.depth + 1) FROM r JOIN e ON src = r.v
        WHERE r.depth < 49 AND NOT EXISTS (SELECT 1 FROM recurring.r k WHERE k.v = dst) GROUP BY dst),
        b AS (SELECT v, depth FROM r)
        SELECT f.v, f.kind, depth FROM (SELECT v, CASE WHEN is_class THEN 'class' ELSE 'function' END AS kind FROM ty UNION ALL SELECT v, 'function' FROM ini) f LEFT JOIN b USING (v)""",
)
def _(t):
    typed = t.once("typed", lambda: spark_feed(t, _TYPED))
    inits = typed.filter("is_class AND has_init").select(F.concat("v", F.lit(".__init__")).alias("v"))
    functions = typed.filter("NOT is_class").select("v").unionByName(inits)
    n = spark_feed(t, feeds.NODES)
    p = n.select("run_id", F.col("node").alias("parent"), F.col("fn").alias("pfn"))
    plain = n.join(p, ["run_id", "parent"]).select(F.concat_ws("/", "run_id", "pfn").alias("src"), F.concat_ws("/", "run_id", "fn").alias("dst"))
    made = spark_feed(t, _INIT).join(inits.withColumnRenamed("v", "src"), "src", "left_semi")
    classes = typed.filter("is_class").select("v")
    edges = trees.through_constructors(plain.unionByName(made.select("src", "dst")), classes, functions)
    start = plain.filter(F.col("src").endswith("main:<module>")).select(F.col("dst").alias("v"))
    reached = trees.reach(edges, start, 50)
    kinds = classes.withColumn("kind", F.lit("class")).unionByName(functions.withColumn("kind", F.lit("function")))
    return kinds.join(reached, "v", "left")


@query(
    "gr4_intervals",
    f"""WITH RECURSIVE n AS {_ND}, p(run_id, node, path, up) AS (SELECT run_id, node, [node], parent FROM n
        UNION ALL SELECT p.run_id, p.node, list_prepend(n.node, p.path), n.parent FROM p JOIN n ON n.run_id = p.run_id AND n.node = p.up),
        c AS (SELECT run_id, node, path, row_number() OVER (PARTITION BY run_id ORDER BY path) - 1 AS first FROM p WHERE up IS NULL),
        s AS (SELECT run_id, a AS node, count(*) AS size FROM (SELECT run_id, unnest(path) AS a FROM c) GROUP BY ALL)
        SELECT run_id, node, first, first + size - 1 AS last, (len(path) - 1)::bigint AS depth FROM c JOIN s USING (run_id, node)""",
)
def _(t):
    return trees.intervals(spark_feed(t, feeds.NODES), ["run_id"], "node", "parent", "node")


@query(
    "gr4_chain",
    f"""WITH RECURSIVE n AS {_ND}, p(run_id, node, path, up) AS (SELECT run_id, node, [node], parent FROM n
        UNION ALL SELECT p.run_id, p.node, list_prepend(n.node, p.path), n.parent FROM p JOIN n ON n.run_id = p.run_id AND n.node = p.up)
        SELECT run_id, node, path, (len(path) - 1)::bigint AS depth FROM p WHERE up IS NULL""",
)
def _(t):
    p = trees.tree_paths(spark_feed(t, feeds.NODES), ["run_id"], "node", "parent")
    return p.select("run_id", "node", F.transform("path", lambda x: x["node"]).alias("path"), "depth")


# call sites: runs of 24 events, eight functions, three call sites each
_SITES = "SELECT cast(floor(event_id / 24) AS bigint) AS run, event_id % 8 AS src, cast(floor((event_id % 24) / 8) AS bigint) AS pos, k % 8 AS dst FROM (" + feeds.EV + ") e"


@query(
    "gr7_reading_order",
    f"""WITH RECURSIVE s AS {oracle_feed(_SITES)}, w(run, fn, path, via) AS (SELECT DISTINCT run, 0::bigint, []::bigint[], [0::bigint] FROM s
        UNION ALL SELECT s.run, s.dst, list_append(path, s.pos), list_append(via, s.dst) FROM w JOIN s ON s.run = w.run AND s.src = w.fn WHERE NOT list_contains(via, s.dst))
        SELECT run, fn, min(path) AS path FROM w GROUP BY run, fn""",
)
def _(t):
    s = spark_feed(t, _SITES)
    entry = s.select("run").distinct().withColumn("fn", F.lit(0).cast("long"))
    return trees.walk_order(s, entry, "run")


# the same sites as statements: some stand in a block of the statement before
_BLOCKS = "SELECT run, src, pos, dst, CASE k % 6 WHEN 0 THEN 'if' WHEN 1 THEN 'for' WHEN 2 THEN 'try' ELSE 'call' END AS kind, CASE WHEN pos > 0 AND k % 5 > 1 THEN pos - 1 END AS parent, CASE WHEN k % 4 = 0 THEN 'else' ELSE 'body' END AS block FROM (SELECT cast(floor(event_id / 24) AS bigint) AS run, event_id % 8 AS src, cast(floor((event_id % 24) / 8) AS bigint) AS pos, k % 8 AS dst, k FROM (" + feeds.EV + ") e) x"


@query(
    "gr7_reading_steps",
    f"""WITH RECURSIVE s AS {oracle_feed(_BLOCKS)}, w(run, fn, path, via) AS (SELECT DISTINCT run, 0::bigint, []::bigint[], [0::bigint] FROM s
        UNION ALL SELECT s.run, s.dst, list_append(path, s.pos), list_append(via, s.dst) FROM w JOIN s ON s.run = w.run AND s.src = w.fn WHERE NOT list_contains(via, s.dst)),
        f AS (SELECT run, fn, min(path) AS path FROM w GROUP BY run, fn),
        a AS (SELECT s.*, list_append(f.path, s.pos) AS loc, d.path AS way FROM s JOIN f ON f.run = s.run AND f.fn = s.src LEFT JOIN f d ON d.run = s.run AND d.fn = s.dst),
        o AS (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS step FROM (SELECT run, loc AS k FROM a UNION ALL SELECT run, list_append(path, -1) FROM f)),
        g(run, src, pos, up, possible, repeats) AS (SELECT run, src, pos, parent, false, false FROM s
          UNION ALL SELECT g.run, g.src, g.pos, p.parent, g.possible OR p.kind IN ('if', 'match') OR (p.kind = 'try' AND c.block <> 'body'), g.repeats OR p.kind IN ('for', 'while')
          FROM g JOIN s p ON p.run = g.run AND p.src = g.src AND p.pos = g.up JOIN s c ON c.run = g.run AND c.src = g.src AND c.pos = p.pos + 1)
        SELECT a.run, o.step, a.src, a.pos, a.dst, coalesce(a.way = a.loc, false) AS entered, e.step AS see, g.possible, g.repeats
        FROM a JOIN o ON o.run = a.run AND o.k = a.loc JOIN g ON g.run = a.run AND g.src = a.src AND g.pos = a.pos AND g.up IS NULL
        LEFT JOIN o e ON e.run = a.run AND e.k = list_append(a.way, -1) AND a.way <> a.loc""",
)
def _(t):
    s = t.once("sites", lambda: spark_feed(t, _BLOCKS))
    entry = s.select("run").distinct().withColumn("fn", F.lit(0).cast("long"))
    return trees.reading_steps(s, trees.walk_order(s, entry, "run"), "run")


_GREEDY = """
d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS rn FROM documents),
g(source, rn, doc_id, left_over, kept) AS (
  SELECT source, rn, doc_id, CASE WHEN n_chars <= 60000 THEN 60000 - n_chars ELSE 60000 END, n_chars <= 60000 FROM d WHERE rn = 1
  UNION ALL SELECT d.source, d.rn, d.doc_id, CASE WHEN n_chars <= left_over THEN left_over - n_chars ELSE left_over END, n_chars <= left_over
  FROM g JOIN d ON d.source = g.source AND d.rn = g.rn + 1)"""


@query("gr8_budget", f"WITH RECURSIVE {_GREEDY} SELECT source, doc_id, kept FROM g")
def _(t):
    docs = t.documents.select("source", "lang", "doc_id", "n_chars")
    return trees.fit_budget(docs, ["source"], ["lang", "doc_id"], "n_chars", 60000).select("source", "doc_id", "kept")


@query("top5_functions_by_priority", f"WITH RECURSIVE {_GREEDY} SELECT source, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS trimmed FROM g GROUP BY source ORDER BY source")
def _(t):
    docs = t.documents.select("source", "lang", "doc_id", "n_chars")
    fit = trees.fit_budget(docs, ["source"], ["lang", "doc_id"], "n_chars", 60000)
    return fit.groupBy("source").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("trimmed")).orderBy("source")


@query(
    "gr9_top_level_lines",
    r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
        SELECT doc_id, line, code FROM x LEFT JOIN labels l USING (doc_id) WHERE regexp_matches(code, '\S')
        AND NOT coalesce(line BETWEEN 1 + quality AND 2 + quality + toxic, false)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) <= 300""",
)
def _(t):
    from ..operators.ordered import first_k

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "code")).withColumn("line", (F.col("line") + 1).cast("long"))
    covered = t.labels.select("doc_id", F.explode(F.sequence((F.col("quality") + 1).cast("long"), (F.col("quality") + 2 + F.col("toxic")).cast("long"))).alias("line")).distinct()
    top = lines.filter(F.regexp_like("code", F.lit(r"\S"))).join(covered, ["doc_id", "line"], "left_anti")
    return first_k(top, ["doc_id"], ["line"], 300)
