"""Streaming queries over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, effects, readings
from ..session import scratch_path
from ..streaming import operators as S
from ..streaming.runner import append_run, each_batch, file_stream, update_run
from . import feeds
from .aggregates import WIDE, _WD
from .feeds import oracle_feed, spark_feed
from .jobs import _ACC
from .registry import Tables, query


class StreamTables(Tables):
    """The tables with ``events`` as a stream."""

    def __getattr__(self, name: str):
        if name == "events":
            return file_stream(self.spark, super().__getattr__(name).schema, self.path, "events.parquet")
        return super().__getattr__(name)


def live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.path)


def places(t, label: str) -> tuple[str, str]:
    return scratch_path(t.spark, label), scratch_path(t.spark, label + "-state")


def in_thirds(t: Tables, feed: str):
    """A feed of runs as a stream of three micro-batches, each with a third of every run; ``ts`` is its event time."""
    folder = scratch_path(t.spark, "arrivals")
    for third in range(3):
        part = t.events.filter(F.floor(F.col("event_id") % 200 / 67) == third)
        part.write.mode("append").parquet(folder)
    arriving = file_stream(t.spark, t.events.schema, folder, files_per_batch=max(1, len(t.spark.read.parquet(folder).inputFiles()) // 3))
    place = t.spark.sql("SELECT * FROM {e}", e=arriving)
    rows = t.spark.sql(feed.replace("{events}", "{e}"), e=place)
    number = F.col("seq") if "seq" in rows.columns else F.col("node")
    return rows.withColumn("ts", F.timestamp_seconds(number + 1_000_000))


@query("str1_line_parse", f"WITH {_ACC} SELECT * FROM rq")
def _(t):
    return append_run(access.parse(spark_feed(live(t), feeds.LOG)), *places(t, "parse"))


@query("str2_running_counts", f"WITH {_ACC} SELECT endpoint, requests, errors, error_rate FROM er")
def _(t):
    return update_run(S.running_rates(spark_feed(live(t), feeds.LOG)), *places(t, "rates"), keys=["endpoint"])


# hour of the reading, value and station; the hour is the event time
_READ = "SELECT event_id AS pos, user_id AS station_id, date_trunc('hour', ts) AS timestamp, value AS temp FROM {events}"
_RD = oracle_feed(_READ)


@query(
    "str3_daily_windows",
    f"""SELECT station_id, cast(timestamp AS date) AS day, min(temp) AS min, max(temp) AS max,
        round_even(sum(cast(temp AS decimal(28,8)))::double / count(temp) * 100, 0) / 100 AS mean, count(temp) AS count FROM {_RD} r
        GROUP BY station_id, cast(timestamp AS date) HAVING cast(timestamp AS date) + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 2 HOUR FROM {_RD} r)""",
)
def _(t):
    # days that are not over at the watermark stay open
    return append_run(S.daily_windows(spark_feed(live(t), _READ), "2 hours"), *places(t, "daily"))


@query("str4_drop_repeats", f"SELECT DISTINCT station_id, timestamp FROM {_RD} r")
def _(t):
    return append_run(S.drop_repeats(spark_feed(live(t), _READ), "2 hours"), *places(t, "repeats")).select("station_id", "timestamp")


@query("str5_stream_enrich", f"SELECT r.pos, r.station_id, s.name, s.region FROM {_RD} r LEFT JOIN {oracle_feed(feeds.STATIONS)} s USING (station_id)")
def _(t):
    out = readings.enrich(spark_feed(live(t), _READ), spark_feed(t, feeds.STATIONS)).select("pos", "station_id", "name", "region")
    return append_run(out, *places(t, "enrich"))


@query(
    "str6_coalesced_effects",
    f"""SELECT run_id, kind, op, target, fn, handled, min(seq) AS seq, count(*) AS count, sum(n_rows)::bigint AS n_rows
        FROM {oracle_feed(feeds.IO)} i GROUP BY run_id, kind, op, target, fn, handled""",
)
def _(t):
    keys = ["run_id", "kind", "op", "target", "fn", "handled"]
    out = effects.coalesce_io(spark_feed(live(t), feeds.IO)).select(*keys, "seq", "count", "n_rows")
    return update_run(out, *places(t, "effects"), keys=keys)


@query(
    "str7_first_calls",
    f"""SELECT run_id, parent, fn, min(n) - 3 AS more, list(node ORDER BY node) AS nodes FROM (SELECT *, count(*) OVER (PARTITION BY run_id, parent, fn) AS n FROM {_WD} w
        WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, parent, fn ORDER BY node) <= 3) x GROUP BY run_id, parent, fn""",
)
def _(t):
    calls = in_thirds(t, WIDE).filter("parent is not null")
    rows = update_run(S.first_calls(calls), *places(t, "first"), keys=["run_id", "parent", "fn"])
    return rows.select("run_id", "parent", "fn", (F.col("seen") - 3).alias("more"), "nodes")


# starts and ends of calls of three threads per run
CALLS = f"""SELECT run_id, k % 3 AS thread, pos AS seq, concat('t', k % 3) AS fn, event_type IN ('view', 'click', 'signup') AS is_start, pos * 2.0E0 AS t_ms FROM ({feeds.EV}) e"""


@query(
    "str8_call_stack",
    f"""WITH c AS {oracle_feed(CALLS)},
        r AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE -1 END) OVER w AS raw FROM c WINDOW w AS (PARTITION BY run_id, thread ORDER BY seq)),
        d AS (SELECT *, (raw - least(0, min(raw) OVER (PARTITION BY run_id, thread ORDER BY seq)))::bigint AS after FROM r),
        e AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY run_id, thread ORDER BY seq), 0) AS before FROM d),
        m AS (SELECT e.run_id, e.thread, e.seq AS end_seq, e.fn, e.after AS depth, e.t_ms,
                (SELECT max(s.seq) FROM e s WHERE s.run_id = e.run_id AND s.thread = e.thread AND s.is_start AND s.after = e.before AND s.seq < e.seq) AS seq
              FROM e WHERE NOT is_start AND before > 0)
        SELECT run_id, thread, seq, end_seq, fn, depth, t_ms - seq * 2.0 AS dur_ms FROM m""",
)
def _(t):
    return append_run(S.paired_calls(in_thirds(t, CALLS)), *places(t, "stack"))


@query(
    "str9_alert_outbox",
    f"""WITH {_ACC} SELECT format('Error rate {{:.1f}}% in last night''s traffic', errors / requests * 100) AS subject FROM tot WHERE errors / requests > 0.05""",
)
def _(t):
    out, state = places(t, "outbox")
    each_batch(spark_feed(live(t), feeds.LOG), state, S.alert_batch(out))
    return t.spark.read.parquet(out).select("subject")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "str9_window_alerts",
    f"""WITH l AS (SELECT l.*, e.ts FROM {oracle_feed(feeds.LOG)} l JOIN events e ON e.event_id = l.line_no), {_ACC},
        r AS (SELECT time_bucket(INTERVAL 7 DAY, l.ts, TIMESTAMP '1970-01-01') AS start, regexp_replace(split_part(rq.path, '?', 1), '/[0-9]+', '/:id', 'g') AS endpoint,
                count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors, min(rq.line_no) AS first_line
              FROM rq JOIN l ON l.line_no = rq.line_no GROUP BY 1, 2),
        tot9 AS (SELECT start, sum(requests) AS r, sum(errors) AS e FROM r GROUP BY start HAVING sum(errors) / sum(requests) > 0.05 AND start + INTERVAL 7 DAY <= {_CLOSED}),
        b AS (SELECT start, string_agg(concat(endpoint, ': ', errors, ' errors'), chr(10) ORDER BY errors DESC, requests DESC, first_line) AS body FROM
              (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY start ORDER BY errors DESC, requests DESC, first_line) <= 5) GROUP BY start)
        SELECT start, format('Error rate {{:.1f}}% in the traffic', round_even(e / r * 1000, 0) / 10) AS subject, body FROM tot9 JOIN b USING (start)""",
)
def _(t):
    """Alerts judged by weeks of event time: lines, rates and bodies are the same however they arrive."""
    out, state = places(t, "weeks")
    lines = spark_feed(live(t), feeds.LOG.replace("SELECT event_id AS line_no,", "SELECT event_id AS line_no, ts,", 1))
    lines = lines.withColumn("ts", F.col("ts").cast("timestamp"))
    each_batch(S.window_rates(lines, "7 days", "1 hour"), state, S.window_alert_batch(out))
    return t.spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "subject", "body")


@query(
    "str10_late_rows",
    """WITH m AS (SELECT max(ts) - INTERVAL 10 DAY AS mark FROM events WHERE event_id % 2 = 0)
       SELECT event_id % 2 = 1 AND ts < mark AS late, count(*) AS n FROM events, m GROUP BY 1""",
)
def _(t):
    # half of the events arrive first, the other half after a restart: of these, some are older than the watermark
    folder, (out, state) = scratch_path(t.spark, "arrivals"), places(t, "late")
    for half in (0, 1):
        t.events.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        found = append_run(S.late_rows(file_stream(t.spark, t.events.schema, folder), "ts", "10 days"), out, state)
    return found.groupBy("late").agg(F.count(F.lit(1)).alias("n"))
