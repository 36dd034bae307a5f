"""Aggregates over calls, lines, reads and writes, imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sql_text
from ..operators import calls, effects, trees
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query
from .text import _SQLC, _STRIP, _sql_kind, _sql_written

_ND = oracle_feed(feeds.NODES)
_EV = oracle_feed(feeds.EV)
_LN = oracle_feed(feeds.LINES)
_IO = oracle_feed(feeds.IO)

# a flatter call tree, in which functions are called often under one call
WIDE = f"""
SELECT run_id, pos + 1 AS node, event_type AS fn, value AS dur_ms,
       CASE WHEN pos = 0 THEN NULL WHEN pos < 10 THEN 1 ELSE pos % 9 + 2 END AS parent
FROM ({feeds.EV}) e"""
_WD = oracle_feed(WIDE)
_KEPT = f"""
w AS (SELECT *, row_number() OVER (PARTITION BY run_id, parent, fn ORDER BY node) AS rn FROM {_WD} w),
d0 AS (SELECT * FROM w WHERE parent IS NULL), d1 AS (SELECT w.* FROM w JOIN d0 ON d0.run_id = w.run_id AND d0.node = w.parent WHERE w.rn <= 3),
d2 AS (SELECT w.* FROM w JOIN d1 ON d1.run_id = w.run_id AND d1.node = w.parent WHERE w.rn <= 3),
kept AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)"""


@query(
    "agg5_function_stats",
    f"""SELECT user_id, event_type, count(*) AS calls, round_even(sum(cast(value AS decimal(28,8)))::double * 100, 0) / 100 AS total_ms
        FROM events GROUP BY ALL""",
)
def _(t):
    c = t.events.select("user_id", "event_type", F.col("value").alias("dur_ms"))
    return calls.function_stats(c, ["user_id", "event_type"])


@query("win3_first_calls", f"WITH {_KEPT} SELECT run_id, node, fn, parent FROM kept")
def _(t):
    return calls.detailed_calls(spark_feed(t, WIDE)).select("run_id", "node", "fn", "parent")


@query(
    "agg6_repeats",
    f"""WITH {_KEPT} SELECT w.run_id, w.parent, w.fn, count(*) - 3 AS repeats FROM w JOIN kept k ON k.run_id = w.run_id AND k.node = w.parent
        GROUP BY ALL HAVING count(*) > 3""",
)
def _(t):
    c = spark_feed(t, WIDE)
    return calls.repeats(c, calls.detailed_calls(c))


@query(
    "agg7_coalesce_io",
    f"""SELECT run_id, kind, op, target, fn, handled, min(seq) AS seq, arg_min(node, seq) AS node, arg_min(t_ms, seq) AS t_ms,
        count(*) AS count, sum(n_rows)::bigint AS n_rows, sum(n_bytes)::bigint AS n_bytes FROM {_IO} i GROUP BY run_id, kind, op, target, fn, handled""",
)
def _(t):
    return effects.coalesce_io(spark_feed(t, feeds.IO))


@query(
    "agg7_coalesce_all_runs",
    f"""SELECT kind, op, target, handled, min(event_id) AS seq, arg_min(node, event_id) AS node, arg_min(t_ms, event_id) AS t_ms,
        count(*) AS count, sum(n_rows)::bigint AS n_rows, sum(n_bytes)::bigint AS n_bytes FROM {_IO} i GROUP BY kind, op, target, handled""",
)
def _(t):
    io = spark_feed(t, feeds.IO).withColumn("seq", F.col("event_id"))
    return effects.coalesce_io(io, ["kind", "op", "target", "handled"])


@query("agg8_line_totals", f"SELECT run_id, file, line, count(*) AS count FROM {_LN} l GROUP BY ALL")
def _(t):
    return spark_feed(t, feeds.LINES).groupBy("run_id", "file", "line").agg(F.count(F.lit(1)).alias("count"))


@query("agg9_lines_per_call", f"SELECT run_id, node, line, count(*) AS count FROM {_LN} l GROUP BY ALL")
def _(t):
    return spark_feed(t, feeds.LINES).groupBy("run_id", "node", "line").agg(F.count(F.lit(1)).alias("count"))


_SHADOW = f"""(SELECT run_id, seq, coalesce({_sql_written('x')}, 'unknown') AS tbl, k AS n_rows FROM (SELECT *, {_STRIP} AS x FROM {_SQLC} s)
              WHERE {_sql_kind('x')} = 'write')"""


def shadow_writes(t):
    s = spark_feed(t, feeds.SQL_CALLS).withColumn("x", sql_text.strip_comments(F.col("q")))
    return s.filter(sql_text.kind(F.col("x")) == "write").select(
        "run_id", "seq", F.coalesce(sql_text.written_table(F.col("x")), F.lit("unknown")).alias("tbl"), F.col("k").alias("n_rows"), "x"
    )


@query(
    "agg10_shadow_rows",
    rf"""SELECT run_id, tbl, sum(n_rows)::bigint AS n_rows, concat(regexp_replace(concat('main__', tbl), '[^\w.-]', '_', 'g'), '.jsonl') AS file
         FROM {_SHADOW} w GROUP BY run_id, tbl""",
)
def _(t):
    from ..functions.text import safe_file_name

    file = F.concat(safe_file_name(F.concat(F.lit("main__"), "tbl")), F.lit(".jsonl"))
    return effects.shadow_rows(shadow_writes(t).withColumn("file", file))


@query(
    "agg11_min_depth",
    f"""WITH RECURSIVE n AS {_ND}, d(run_id, node, fn, depth) AS (SELECT run_id, node, fn, 0::bigint FROM n WHERE parent IS NULL
        UNION ALL SELECT n.run_id, n.node, n.fn, d.depth + 1 FROM d JOIN n ON n.run_id = d.run_id AND n.parent = d.node)
        SELECT run_id, fn, min(depth) AS depth FROM d GROUP BY ALL""",
)
def _(t):
    n = spark_feed(t, feeds.NODES)
    deep = trees.tree_depths(n, ["run_id"], "node", "parent")
    return deep.join(n.select("run_id", "node", "fn"), ["run_id", "node"]).groupBy("run_id", "fn").agg(F.min("depth").alias("depth"))


IMPORTS = f"""
SELECT run_id, pos, concat('mod', k % 7) AS module, CASE k % 3 WHEN 0 THEN 'numpy.linalg' WHEN 1 THEN concat('lib', k % 5) ELSE concat('etl.', event_type) END AS target,
       CASE k % 3 WHEN 0 THEN 'third_party' WHEN 1 THEN 'stdlib' ELSE 'project' END AS kind
FROM ({feeds.EV}) e"""
_LIBS = f"""(SELECT run_id, name, arg_min(kind, pos) AS kind, list(module ORDER BY pos) AS used_by FROM
            (SELECT run_id, split_part(target, '.', 1) AS name, module, min(pos) AS pos, arg_min(kind, pos) AS kind
             FROM {oracle_feed(IMPORTS)} i WHERE kind <> 'project' GROUP BY 1, 2, 3) GROUP BY run_id, name)"""


@query("agg12_libraries", f"SELECT * FROM {_LIBS} l")
def _(t):
    return calls.libraries(spark_feed(t, IMPORTS))


@query(
    "top4_libraries",
    f"SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY kind, name) AS place, kind, name FROM {_LIBS} l",
)
def _(t):
    # the libraries of a run are bounded by its source code
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("kind", "name")).cast("long")
    return calls.libraries(spark_feed(t, IMPORTS)).select("run_id", place.alias("place"), "kind", "name")


@query(
    "agg17_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "agg18_last_state",
    f"""SELECT run_id, concat('ENV_', k) AS name, arg_max(event_type <> 'view', pos) AS is_set, arg_max(event_type = 'error', pos) AS secret FROM {_EV} e
        GROUP BY run_id, k""",
)
def _(t):
    e = spark_feed(t, feeds.EV).select(
        "run_id", F.concat(F.lit("ENV_"), "k").alias("name"), "pos",
        (F.col("event_type") != "view").alias("is_set"), (F.col("event_type") == "error").alias("secret"),
    )
    return effects.last_state(e, ["run_id", "name"], "pos", ["is_set", "secret"])


@query(
    "agg20_run_summary",
    f"""SELECT r.run_id, status, seconds, functions, coalesce(io, 0) AS io, coalesce(held, 0) AS held, coalesce(done, 0) AS done FROM
        (SELECT run_id, CASE WHEN count(raised) > 0 THEN 'error' ELSE 'ok' END AS status,
                round_even(sum(cast(dur_ms AS decimal(28,8)))::double / 1000 * 100, 0) / 100 AS seconds, count(DISTINCT fn) AS functions FROM {_ND} n GROUP BY 1) r
        LEFT JOIN (SELECT run_id, count(*) AS io, count(*) FILTER (WHERE coalesce(handled, '') IN ('redirected', 'blocked', 'shadowed', 'working-copy')
             AND op NOT IN ('read', 'connect', 'mkdir')) AS held,
             count(*) FILTER (WHERE coalesce(handled, '') NOT IN ('redirected', 'blocked', 'shadowed', 'working-copy', 'read-redirected')
             AND op NOT IN ('read', 'connect', 'read-after-write')) AS done FROM {_IO} i GROUP BY 1) x ON x.run_id = r.run_id""",
)
def _(t):
    from ..functions.numbers import exact_sum, half_even

    n, io = spark_feed(t, feeds.NODES), spark_feed(t, feeds.IO)
    runs = n.groupBy("run_id").agg(
        F.when(F.count("raised") > 0, "error").otherwise("ok").alias("status"),
        half_even(exact_sum(F.col("dur_ms")).cast("double") / 1000, 2).alias("seconds"),
        F.countDistinct("fn").alias("functions"),
    )
    side = io.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("io"), F.count_if(effects.is_intercepted()).alias("held"), F.count_if(effects.is_real_effect()).alias("done")
    )
    return runs.join(side, "run_id", "left").na.fill(0, ["io", "held", "done"])


@query(
    "agg21_coverage",
    f"""SELECT run_id, least(d, 60)::bigint AS recorded, (n - least(d, 60))::bigint AS counted_only, d > 60 AS truncated FROM
        (SELECT run_id, sum(least(n, 3)) AS d, sum(n) AS n FROM (SELECT run_id, node, line, count(*) AS n FROM {_LN} l GROUP BY ALL) GROUP BY 1)""",
)
def _(t):
    return calls.coverage(spark_feed(t, feeds.LINES), cap=60)


@query("agg23_focus_size", "SELECT source, sum(length(text))::bigint AS chars, sum(length(text)) > 60000 AS over FROM documents GROUP BY source")
def _(t):
    per = t.documents.groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return per.withColumn("over", F.col("chars") > 60000)


@query(
    "agg_empty_input",
    """SELECT user_id, event_type, count(*) AS calls, count(*) * 0.0::double AS total_ms FROM events WHERE event_id < 0 GROUP BY ALL
       UNION ALL SELECT NULL, NULL, count(*), 0.0::double FROM events WHERE event_id < 0""",
)
def _(t):
    none = t.events.filter("event_id < 0").select("user_id", "event_type", F.col("value").alias("dur_ms"))
    total = none.agg(F.count(F.lit(1)).alias("calls")).select(
        F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), "calls", F.lit(0.0).alias("total_ms")
    )
    return calls.function_stats(none, ["user_id", "event_type"]).unionByName(total)
