"""Window queries beside the step tables, and ordered reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import capped, first_k, islands, scan
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

_LN = oracle_feed(feeds.LINES)


@query(
    "win4_first_executions",
    f"SELECT run_id, node, line, seq FROM {_LN} l QUALIFY row_number() OVER (PARTITION BY run_id, node, line ORDER BY seq) <= 3",
)
def _(t):
    return first_k(spark_feed(t, feeds.LINES), ["run_id", "node", "line"], ["seq"], 3).select("run_id", "node", "line", "seq")


@query(
    "win5_role_runs",
    """SELECT conv_id, turn, role, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn)::bigint AS part FROM
       (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS chg FROM conversations)""",
)
def _(t):
    return islands(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role"], "part", settled=True)


@query(
    "win6_event_occurrence",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events",
)
def _(t):
    e = t.events.select("event_id", "user_id", "event_type")
    return scan(e, ["user_id", "event_type"], "event_id", row_number="occurrence", settled=True).select("event_id", "occurrence")


@query(
    "win8_next_event",
    "SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS next_ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_type FROM events",
)
def _(t):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    out = scan(e, ["user_id"], "event_id", lead={"next_ts": "ts"}, lag={"prev_type": "event_type"}, settled=True)
    return out.select("event_id", "next_ts", "prev_type")


# stages of a job: the events of a user, one row count each
@query(
    "win16_rows_delta",
    f"SELECT user_id, event_id, k AS n_rows, k - lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM {oracle_feed(feeds.EV)} e",
)
def _(t):
    e = spark_feed(t, feeds.EV).select("user_id", "event_id", F.col("k").alias("n_rows"))
    out = scan(e, ["user_id"], "event_id", lag={"__p": "n_rows"}, settled=True)
    return out.select("user_id", "event_id", "n_rows", (F.col("n_rows") - F.col("__p")).alias("delta"))


@query(
    "win18_caps",
    """SELECT e.user_id, e.event_id, n > 50 AS truncated FROM (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 50) e
       JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) c ON c.user_id = e.user_id""",
)
def _(t):
    e = t.events.select("user_id", "event_id")
    n = e.groupBy("user_id").agg((F.count(F.lit(1)) > 50).alias("truncated"))
    return first_k(e, ["user_id"], ["event_id"], 50).join(n, "user_id")


_CAPS = {"nodes": 150, "line_events": 120, "io_events": 200}
_CAPPED = f"""(SELECT 'nodes' AS tbl, run_id, node AS id FROM {oracle_feed(feeds.NODES)} n QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY node) <= 150
    UNION ALL SELECT 'line_events', run_id, seq FROM {_LN} l QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) <= 120
    UNION ALL SELECT 'io_events', run_id, seq FROM {oracle_feed(feeds.IO)} i QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq) <= 200)"""


@query(
    "win18_run_caps",
    f"""WITH n AS (SELECT run_id, (SELECT count(*) FROM {oracle_feed(feeds.NODES)} x WHERE x.run_id = r.run_id) AS a, (SELECT count(*) FROM {_LN} x WHERE x.run_id = r.run_id) AS b
          FROM (SELECT DISTINCT run_id FROM {oracle_feed(feeds.NODES)} x) r)
        SELECT c.run_id, c.tbl, count(*) AS kept, max(c.id) AS last, any_value(n.a > 150 OR n.b > 120) AS truncated,
          any_value(list_filter([CASE WHEN n.a > 150 THEN 'nodes' END, CASE WHEN n.b > 120 THEN 'line_events' END], lambda x: x IS NOT NULL)) AS over
        FROM {_CAPPED} c JOIN n ON n.run_id = c.run_id GROUP BY c.run_id, c.tbl""",
)
def _(t):
    tables = {
        "nodes": (spark_feed(t, feeds.NODES).select("run_id", F.col("node").alias("id")), ["id"], _CAPS["nodes"]),
        "line_events": (spark_feed(t, feeds.LINES).select("run_id", F.col("seq").alias("id")), ["id"], _CAPS["line_events"]),
        "io_events": (spark_feed(t, feeds.IO).select("run_id", F.col("seq").alias("id")), ["id"], _CAPS["io_events"]),
    }
    kept, flags = capped(tables, ["run_id"])
    rows = reduce(DataFrame.unionByName, [df.withColumn("tbl", F.lit(name)) for name, df in kept.items()])
    per = rows.groupBy("run_id", "tbl").agg(F.count(F.lit(1)).alias("kept"), F.max("id").alias("last"))
    return per.join(flags, "run_id")


@query("top6_events_by_seq", f"SELECT event_id, run_id, seq, op FROM {oracle_feed(feeds.IO)} i ORDER BY run_id, seq")
def _(t):
    return spark_feed(t, feeds.IO).select("event_id", "run_id", "seq", "op").orderBy("run_id", "seq")


@query("top8_line_totals", f"SELECT file, line, count(*) AS count FROM {_LN} l GROUP BY ALL ORDER BY file, line")
def _(t):
    return spark_feed(t, feeds.LINES).groupBy("file", "line").agg(F.count(F.lit(1)).alias("count")).orderBy("file", "line")
