"""Joins and set operations."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..operators import calls, lookups, trees
from ..operators.ordered import first_k
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

_ND = oracle_feed(feeds.NODES)
_EV = oracle_feed(feeds.EV)
_ST = oracle_feed(feeds.STATEMENTS)

# functions defined in the code of a run
FUNCTIONS = f"""
SELECT run_id, concat('m', k % 7, ':', n) AS fn, concat('m', k % 7) AS module, n AS qualname, n AS name, min(pos) AS line
FROM (SELECT run_id, k, pos, CASE WHEN k % 9 = 0 THEN '__init__' WHEN k % 4 = 0 THEN concat(event_type, '_', k % 3) ELSE event_type END AS n FROM ({feeds.EV}) e) x
GROUP BY run_id, k % 7, n"""
_FN = oracle_feed(FUNCTIONS)
_RAN = f"(SELECT run_id, fn, count(*) AS calls, round_even(sum(cast(dur_ms AS decimal(28,8)))::double * 100, 0) / 100 AS total_ms FROM {_ND} n WHERE node % 3 = 0 GROUP BY ALL)"


def ran(t):
    return spark_feed(t, feeds.NODES).filter("node % 3 = 0")


@query("jn6_parent", f"SELECT n.run_id, n.node, n.fn, p.fn AS caller FROM {_ND} n LEFT JOIN {_ND} p ON n.run_id = p.run_id AND n.parent = p.node")
def _(t):
    n = spark_feed(t, feeds.NODES)
    p = n.select("run_id", F.col("node").alias("parent"), F.col("fn").alias("caller"))
    return n.join(p, ["run_id", "parent"], "left").select("run_id", "node", "fn", "caller")


@query("jn7_function_stats", f"SELECT f.run_id, f.fn, calls, total_ms, calls IS NOT NULL AS executed FROM {_FN} f LEFT JOIN {_RAN} r USING (run_id, fn)")
def _(t):
    stats = calls.function_stats(ran(t), ["run_id", "fn"])
    return calls.executed(spark_feed(t, FUNCTIONS), stats).select("run_id", "fn", "calls", "total_ms", "executed")


@query("jn8_never_ran", f"SELECT run_id, fn FROM {_FN} f ANTI JOIN {_RAN} r USING (run_id, fn) WHERE NOT starts_with(name, '__')")
def _(t):
    return calls.never_ran(spark_feed(t, FUNCTIONS), ran(t)).select("run_id", "fn")


@query("jn8_orders_without_lines", "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


EXPL = f"""
SELECT run_id, concat('f', k % 5, '.py:', k % 25) AS stmt, min(pos) AS pos FROM ({feeds.EV}) e GROUP BY run_id, concat('f', k % 5, '.py:', k % 25)"""
_EX = oracle_feed(EXPL)
_SHOWN = f"(SELECT *, price > 150000 AS shown, price > 150000 AND grp IS NOT NULL AS tail FROM {_ST} s)"


def shown(t):
    s = spark_feed(t, feeds.STATEMENTS).withColumn("shown", F.col("price") > 150000)
    return s.withColumn("tail", F.col("shown") & F.col("grp").isNotNull())


@query(
    "jn10_unknown_statement",
    f"""SELECT e.run_id, e.stmt, h.hint FROM {_EX} e ANTI JOIN {_ST} s USING (run_id, stmt)
        LEFT JOIN (SELECT run_id, file, list(line ORDER BY ord)[1:12] AS hint FROM {_ST} s GROUP BY ALL) h
        ON h.run_id = e.run_id AND h.file = split_part(e.stmt, ':', 1)""",
)
def _(t):
    return lookups.unknown_statements(spark_feed(t, EXPL), spark_feed(t, feeds.STATEMENTS)).select("run_id", "stmt", "hint")


@query(
    "jn11_not_shown",
    f"""SELECT e.run_id, e.stmt, CASE WHEN NOT shown THEN 'not a step' ELSE 'inside a group' END AS warning FROM {_EX} e JOIN {_SHOWN} s USING (run_id, stmt)
        WHERE NOT shown OR tail""",
)
def _(t):
    e = spark_feed(t, EXPL).join(shown(t), ["run_id", "stmt"])
    return e.filter(~F.col("shown") | F.col("tail")).select(
        "run_id", "stmt", F.when(~F.col("shown"), "not a step").otherwise("inside a group").alias("warning")
    )


_COVER = f"""(SELECT run_id, count(*) AS top, count(*) FILTER (WHERE e.stmt IS NULL AND NOT tail) AS missing FROM
    (SELECT * FROM {_SHOWN} s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY price DESC, stmt) <= 20) s LEFT JOIN {_EX} e USING (run_id, stmt)
    GROUP BY run_id)"""


@query("jn12_coverage", f"SELECT run_id, top, missing, missing > floor(top / 2) AS warning FROM {_COVER} c")
def _(t):
    top = first_k(shown(t), ["run_id"], [F.desc("price"), "stmt"], 20)
    both = top.join(spark_feed(t, EXPL).select("run_id", "stmt", F.lit(True).alias("has")), ["run_id", "stmt"], "left")
    out = both.groupBy("run_id").agg(F.count(F.lit(1)).alias("top"), F.count_if(F.col("has").isNull() & ~F.col("tail")).alias("missing"))
    return out.withColumn("warning", F.col("missing") > F.floor(F.col("top") / 2))


@query("jn12_unlabelled_documents", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "source")


_LIB = "SELECT run_id, CASE k % 6 WHEN 0 THEN 'boto3' WHEN 1 THEN 'redis' WHEN 2 THEN 'sqlalchemy' WHEN 3 THEN 'numpy' WHEN 4 THEN 'mysql.connector' ELSE concat('lib', k) END AS library FROM (" + feeds.EV + ") e"


@query(
    "jn13_watched",
    f"""SELECT DISTINCT run_id, library, CASE library WHEN 'boto3' THEN 'AWS SDK calls (S3 uploads, etc.)' WHEN 'redis' THEN 'Redis' ELSE 'MySQL (connector)' END AS what
        FROM {oracle_feed(_LIB)} l WHERE library IN ('boto3', 'redis', 'mysql.connector')""",
)
def _(t):
    return lookups.watched_libraries(spark_feed(t, _LIB))


_RW = f"""
SELECT run_id, pos AS seq, event_type IN ('purchase', 'signup') AS writes, concat('S.Tab', k % 9) AS tbl,
       concat('select a from x.TAB', k % 9, ' join tab', k % 4, '_old, tab', k % 5) AS sql FROM ({feeds.EV}) e"""


@query(
    "jn14_read_after_write",
    rf"""WITH w AS (SELECT run_id, tbl, min(seq) AS first_write FROM {oracle_feed(_RW)} x WHERE writes GROUP BY ALL)
         SELECT r.run_id, r.seq, w.tbl, w.first_write FROM {oracle_feed(_RW)} r JOIN w ON r.run_id = w.run_id AND r.seq > w.first_write
         AND regexp_matches(r.sql, concat('(?i)\b', split_part(w.tbl, '.', -1), '\b')) WHERE NOT r.writes""",
)
def _(t):
    x = spark_feed(t, _RW)
    return lookups.read_after_write(x.filter("not writes"), x.filter("writes"))


_CONST = f"SELECT run_id, concat('C', k) AS name, min(pos) AS line, max(event_type = 'error') AS redacted FROM ({feeds.EV}) e GROUP BY run_id, k"
_RTV = f"SELECT run_id, concat('C', k) AS name, max(value) AS value FROM ({feeds.EV}) e WHERE event_type = 'click' GROUP BY run_id, k"


@query("jn15_constants", f"SELECT c.run_id, c.name, line, value FROM {oracle_feed(_CONST)} c JOIN {oracle_feed(_RTV)} v USING (run_id, name) WHERE NOT redacted")
def _(t):
    return spark_feed(t, _CONST).filter("not redacted").join(spark_feed(t, _RTV), ["run_id", "name"]).select("run_id", "name", "line", "value")


_NAMES = f"""SELECT run_id, k % 10 AS scope, concat('v', k % 40) AS name, CASE event_type WHEN 'view' THEN 'parameter' WHEN 'click' THEN 'local' WHEN 'signup' THEN 'module' ELSE 'builtin' END AS kind,
             CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS prio, event_type <> 'error' AS known FROM ({feeds.EV}) e"""


@query(
    "jn16_name_origin",
    f"""SELECT u.run_id, u.scope, u.name, coalesce(kind, 'unknown') AS kind FROM (SELECT DISTINCT run_id, scope, name FROM {oracle_feed(_NAMES)} n) u
        LEFT JOIN (SELECT run_id, scope, name, arg_min(kind, prio) AS kind FROM {oracle_feed(_NAMES)} n WHERE known GROUP BY ALL) k USING (run_id, scope, name)""",
)
def _(t):
    n = spark_feed(t, _NAMES)
    best = calls.resolve(n.filter("known"), ["run_id", "scope", "name"], "kind")
    used = n.select("run_id", "scope", "name").distinct()
    return used.join(best, ["run_id", "scope", "name"], "left").na.fill("unknown", ["kind"])


# calls as written in the code, what imported names mean, and the functions there are
_USES = f"""SELECT event_id AS use, concat('m', k % 7) AS module, CASE WHEN k % 2 = 0 THEN 'C' END AS cls,
  CASE k % 6 WHEN 0 THEN concat('self.', event_type) WHEN 1 THEN event_type WHEN 2 THEN concat('h', k % 5, '.', event_type)
    WHEN 3 THEN concat('h', k % 5) WHEN 4 THEN concat('h', k % 5, '.sub.', event_type) ELSE concat('obj.', event_type) END AS call FROM ({feeds.EV}) e"""
_MEAN = f"""SELECT module, concat('h', j) AS head, CASE WHEN j % 2 = 0 THEN concat('m', (i + j) % 7) WHEN j = 1 THEN concat('m', (i + 1) % 7, ':view') ELSE concat('m', i, ':n') END AS meaning
  FROM (SELECT DISTINCT concat('m', k % 7) AS module, k % 7 AS i, k % 5 AS j FROM ({feeds.EV}) e) x"""
_IDS = f"""SELECT DISTINCT CASE k % 5 WHEN 0 THEN concat('m', k % 7, ':C.', event_type) WHEN 1 THEN concat('m', k % 7, '.sub:', event_type)
  WHEN 2 THEN concat('m', k % 7, '.n:', event_type) ELSE concat('m', k % 7, ':', event_type) END AS fn FROM ({feeds.EV}) e WHERE value > 5"""
_TARGETS = f"""(
WITH u AS (SELECT u.*, split_part(call, '.', 1) AS head, CASE WHEN contains(call, '.') THEN substr(call, instr(call, '.') + 1) ELSE '' END AS rest FROM {oracle_feed(_USES)} u),
x AS (SELECT u.*, n.meaning, u.head = 'self' AND cls IS NOT NULL AND rest <> '' AND NOT contains(rest, '.') AS own FROM u LEFT JOIN {oracle_feed(_MEAN)} n ON n.module = u.module AND n.head = u.head),
c AS (
 SELECT use, 1 AS prio, concat(module, ':', cls, '.', rest) AS fn FROM x WHERE own
 UNION ALL SELECT use, 2, concat(module, ':', call) FROM x WHERE NOT own
 UNION ALL SELECT use, 3, concat(meaning, CASE WHEN rest <> '' THEN concat('.', rest) ELSE '' END) FROM x WHERE NOT own AND contains(meaning, ':')
 UNION ALL SELECT use, 4, concat(split_part(meaning, ':', 1), '.', split_part(meaning, ':', 2), ':', rest) FROM x WHERE NOT own AND contains(meaning, ':') AND rest <> ''
 UNION ALL SELECT use, 5, concat(meaning, ':', rest) FROM x WHERE NOT own AND meaning IS NOT NULL AND NOT contains(meaning, ':') AND rest <> ''
 UNION ALL SELECT use, 6, concat(meaning, '.', regexp_extract(rest, '^(.*)\\.[^.]*$', 1), ':', regexp_extract(rest, '([^.]*)$', 1)) FROM x
   WHERE NOT own AND meaning IS NOT NULL AND NOT contains(meaning, ':') AND contains(rest, '.'))
SELECT use, arg_min(c.fn, prio) AS target FROM c JOIN {oracle_feed(_IDS)} f ON f.fn = c.fn GROUP BY use)"""


def targets(t):
    return lookups.call_targets(spark_feed(t, _USES), spark_feed(t, _MEAN), spark_feed(t, _IDS))


@query("jn17_call_target", f"SELECT * FROM {_TARGETS} t")
def _(t):
    return targets(t)


@query("gr2_call_edges", f"SELECT DISTINCT u.module, u.cls, t.target FROM {oracle_feed(_USES)} u JOIN {_TARGETS} t USING (use)")
def _(t):
    return spark_feed(t, _USES).join(targets(t), "use").select("module", "cls", "target").distinct()


_IMPS = f"SELECT event_id AS use, concat('p', k % 4, CASE WHEN k % 3 = 0 THEN '.q.r' WHEN k % 3 = 1 THEN concat('.', event_type) ELSE '' END) AS target, concat('n', k % 6) AS n1, event_type AS n2 FROM ({feeds.EV}) e"
_MODS = f"SELECT DISTINCT CASE k % 4 WHEN 0 THEN concat('p', k % 3) WHEN 1 THEN concat('p', k % 3, '.q') WHEN 2 THEN concat('p', k % 3, '.', event_type) ELSE concat('p', k % 3, '.q.r.n', k % 6) END AS module FROM ({feeds.EV}) e"


@query(
    "jn18_import_candidates",
    f"""WITH i AS {oracle_feed(_IMPS)}, c AS (SELECT use, target AS module FROM i UNION SELECT use, concat(target, '.', n1) FROM i UNION SELECT use, concat(target, '.', n2) FROM i
        UNION SELECT use, array_to_string(string_split(target, '.')[1:g], '.') FROM i, range(1, 4) r(g) WHERE g < len(string_split(target, '.')))
        SELECT use, module FROM c JOIN {oracle_feed(_MODS)} m USING (module)""",
)
def _(t):
    i = spark_feed(t, _IMPS).select("use", "target", F.array("n1", "n2").alias("names"))
    return lookups.import_candidates(i).select("use", F.col("candidate").alias("module")).join(spark_feed(t, _MODS), "module").select("use", "module")


@query(
    "jn20_source_priority",
    f"""WITH RECURSIVE n AS {_ND}, d(run_id, node, fn, depth) AS (SELECT run_id, node, fn, 0::bigint FROM n WHERE parent IS NULL
        UNION ALL SELECT n.run_id, n.node, n.fn, d.depth + 1 FROM d JOIN n ON n.run_id = d.run_id AND n.parent = d.node)
        SELECT f.run_id, f.fn, coalesce(m.depth, CASE WHEN r.fn IS NOT NULL THEN 50 END, 99) AS priority FROM {_FN} f
        LEFT JOIN (SELECT run_id, fn, min(depth) AS depth FROM d WHERE node % 2 = 0 GROUP BY ALL) m USING (run_id, fn)
        LEFT JOIN (SELECT DISTINCT run_id, fn FROM n) r USING (run_id, fn)""",
)
def _(t):
    n = spark_feed(t, feeds.NODES)
    seen = trees.tree_depths(n, ["run_id"], "node", "parent").filter("node % 2 = 0").join(n.select("run_id", "node", "fn"), ["run_id", "node"])
    depths = seen.groupBy("run_id", "fn").agg(F.min("depth").alias("depth"))
    return lookups.source_priority(spark_feed(t, FUNCTIONS), depths, n).select("run_id", "fn", "priority")


_QUAL = f"SELECT event_id, concat('f', k % 4, '.py') AS file, CASE WHEN k % 3 = 0 THEN concat(event_type, '.<locals>.inner.<locals>.x') WHEN k % 3 = 1 THEN event_type ELSE concat(event_type, '2') END AS qual FROM ({feeds.EV}) e"


@query(
    "prd10_focus",
    f"""SELECT * FROM {oracle_feed(_QUAL)} q WHERE file = 'f1.py' OR (file = 'f2.py' AND (qual = 'view' OR starts_with(qual, 'view.<locals>.')))
        OR (file = 'f3.py' AND (qual = 'click.<locals>.inner' OR starts_with(qual, 'click.<locals>.inner.<locals>.')))""",
)
def _(t):
    return lookups.in_focus(spark_feed(t, _QUAL), ["f1.py"], [("f2.py", "view"), ("f3.py", "click.<locals>.inner")])


@query(
    "chk10_unresolved_focus",
    f"""SELECT DISTINCT item FROM (SELECT CASE k % 4 WHEN 0 THEN concat('m', k % 9) WHEN 1 THEN concat('m', k % 9, ':', event_type) WHEN 2 THEN event_type ELSE concat('x', k) END AS item FROM {_EV} e)
        WHERE item NOT IN (SELECT module FROM {_FN} f UNION SELECT name FROM {_FN} f UNION SELECT fn FROM {_FN} f)""",
)
def _(t):
    item = F.expr("CASE k % 4 WHEN 0 THEN concat('m', k % 9) WHEN 1 THEN concat('m', k % 9, ':', event_type) WHEN 2 THEN event_type ELSE concat('x', k) END")
    items = spark_feed(t, feeds.EV).select(item.alias("item")).distinct()
    return lookups.unresolved_items(items, spark_feed(t, FUNCTIONS))


_TARGETS_OF = f"""SELECT event_id, run_id, CASE k % 6 WHEN 0 THEN 'json.decoder' WHEN 1 THEN 'pandas' WHEN 2 THEN concat('etl.', event_type) WHEN 3 THEN 'csv' WHEN 4 THEN concat('x', k) ELSE 'pyspark.sql' END AS target FROM ({feeds.EV}) e"""
# one run has a module of its own that is called like a library
_OWN = f"""SELECT DISTINCT run_id, CASE WHEN k % 3 = 0 AND run_id % 2 = 0 THEN 'csv' ELSE 'etl.clean' END AS module FROM ({feeds.EV}) e"""


def _library_rows() -> str:
    return ", ".join(f"('{n}', 'stdlib')" for n in sorted(sys.stdlib_module_names)) + ", ('pandas', 'third_party'), ('pyspark', 'third_party')"


@query(
    "fn19_import_tables",
    f"""WITH lib(top, kind) AS (VALUES {_library_rows()})
        SELECT i.event_id, i.target, CASE WHEN EXISTS (SELECT 1 FROM {oracle_feed(_OWN)} o WHERE o.run_id = i.run_id AND split_part(o.module, '.', 1) = split_part(i.target, '.', 1)) THEN 'project'
          ELSE coalesce(l.kind, 'missing') END AS kind FROM {oracle_feed(_TARGETS_OF)} i LEFT JOIN lib l ON l.top = split_part(i.target, '.', 1)""",
)
def _(t):
    found = lookups.import_classes(spark_feed(t, _TARGETS_OF), spark_feed(t, _OWN), lookups.library_names(t.spark))
    return found.select("event_id", "target", "kind")


# ---- set operations


@query("set1_calls_and_references", f"SELECT run_id, fn FROM {_FN} f UNION SELECT run_id, fn FROM {_ND} n WHERE raised IS NOT NULL")
def _(t):
    a = spark_feed(t, FUNCTIONS).select("run_id", "fn")
    return a.union(spark_feed(t, feeds.NODES).filter("raised is not null").select("run_id", "fn")).distinct()


@query("set2_difference", f"SELECT run_id, fn FROM {_FN} f EXCEPT SELECT run_id, fn FROM {_ND} n WHERE node % 3 = 0")
def _(t):
    return spark_feed(t, FUNCTIONS).select("run_id", "fn").exceptAll(ran(t).select("run_id", "fn").distinct()).distinct()


@query(
    "set4_first_source",
    f"""SELECT run_id, fn, arg_min(src, p) AS src, arg_min(line, p) AS line FROM (SELECT run_id, fn, 'static' AS src, line, 0 AS p FROM {_FN} f
        UNION ALL SELECT run_id, fn, 'seen', min(node), 1 FROM {_ND} n GROUP BY ALL) GROUP BY run_id, fn""",
)
def _(t):
    static = spark_feed(t, FUNCTIONS).select("run_id", "fn", F.lit("static").alias("src"), "line")
    seen = spark_feed(t, feeds.NODES).groupBy("run_id", "fn").agg(F.lit("seen").alias("src"), F.min("node").alias("line"))
    return calls.prefer_first([static, seen], ["run_id", "fn"])
