"""Filters, projections and functions over arrays, maps and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions import names
from ..operators import effects
from ..sources import settings
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

_PATHS = oracle_feed(feeds.PATHS)
_EX = "[" + ", ".join(f"'{x}'" for x in names.EXCLUDED_FOLDERS) + "]"
_EVS = oracle_feed(feeds.EV)


@query(
    "prd8_excluded_folder",
    f"SELECT page_id, path FROM {_PATHS} p WHERE NOT list_has_any(string_split(path, '/')[:-2], {_EX})",
)
def _(t):
    return spark_feed(t, feeds.PATHS).filter(~names.in_excluded_folder(F.col("path"))).select("page_id", "path")


@query(
    "set3_excluded_parts",
    f"SELECT page_id, list_sort(list_intersect(string_split(path, '/')[:-2], {_EX})) AS parts FROM {_PATHS} p",
)
def _(t):
    return spark_feed(t, feeds.PATHS).select("page_id", names.excluded_parts(F.col("path")).alias("parts"))


@query(
    "prd9_user_path",
    f"""SELECT page_id, path FROM {_PATHS} p WHERE NOT (starts_with(path, '/srv/app/src/') OR starts_with(path, '/srv/app/.venv/lib/')
        OR starts_with(path, '/proc/') OR starts_with(path, '/sys/') OR starts_with(path, '/dev/')
        OR ends_with(path, '.pyc') OR ends_with(path, '.pyo'))""",
)
def _(t):
    keep = names.is_user_path(F.col("path"), "/srv/app/src/", ["/srv/app/.venv/lib"])
    return spark_feed(t, feeds.PATHS).filter(keep).select("page_id", "path")


@query("prd11_visible", f"SELECT event_id FROM {_EVS} e WHERE NOT starts_with(concat(CASE WHEN k % 4 = 0 THEN '__' ELSE '_' END, event_type), '__')")
def _(t):
    name = F.concat(F.when(F.col("k") % 4 == 0, "__").otherwise("_"), F.col("event_type"))
    return spark_feed(t, feeds.EV).filter(names.is_visible(name)).select("event_id")


@query(
    "prd13_intercepted",
    f"""SELECT run_id, seq, op, handled, 'intercepted' AS side FROM {oracle_feed(feeds.IO)} i
        WHERE handled IN ('redirected', 'blocked', 'shadowed', 'working-copy') AND op NOT IN ('read', 'connect', 'mkdir')
        UNION ALL
        SELECT run_id, seq, op, handled, 'real' FROM {oracle_feed(feeds.IO)} i
        WHERE coalesce(handled, '') NOT IN ('redirected', 'blocked', 'shadowed', 'working-copy', 'read-redirected')
          AND op NOT IN ('read', 'connect', 'read-after-write')""",
)
def _(t):
    io = spark_feed(t, feeds.IO)
    a = io.filter(effects.is_intercepted()).withColumn("side", F.lit("intercepted"))
    b = io.filter(effects.is_real_effect()).withColumn("side", F.lit("real"))
    return a.unionByName(b).select("run_id", "seq", "op", "handled", "side")


@query(
    "prj5_absent_fields",
    f"""SELECT event_id, CASE WHEN n_rows IS NULL AND n_bytes IS NULL THEN '{{}}' WHEN n_rows IS NULL THEN concat('{{"n_bytes":', n_bytes, '}}')
        WHEN n_bytes IS NULL THEN concat('{{"n_rows":', n_rows, '}}') ELSE concat('{{"n_rows":', n_rows, ',"n_bytes":', n_bytes, '}}') END AS detail
        FROM {oracle_feed(feeds.IO)} i""",
)
def _(t):
    row = F.struct("n_rows", "n_bytes")
    return spark_feed(t, feeds.IO).select("event_id", F.to_json(row, {"ignoreNullFields": "true"}).alias("detail"))


@query(
    "prj6_failure_frame",
    f"""SELECT conv_id, list(concat('f', turn) ORDER BY turn) FILTER (WHERE role <> 'assistant')[-1] AS failed_in,
        count(*) FILTER (WHERE role <> 'assistant') AS frames FROM conversations GROUP BY conv_id
        HAVING count(*) FILTER (WHERE role <> 'assistant') > 0""",
)
def _(t):
    frames = t.conversations.select("conv_id", "turn", F.concat(F.lit("f"), "turn").alias("fn"), (F.col("role") != "assistant").alias("is_project"))
    return effects.failed_in(frames, ["conv_id"], "turn")


_ARR = "list_value(event_type, concat('k', k % 3), event_type, concat('k', k % 5))"


def _tags():
    return F.expr("array(event_type, concat('k', k % 3), event_type, concat('k', k % 5))")



@query(
    "fn24_map_merge",
    f"""SELECT event_id, CASE WHEN event_type = 'view' THEN k + 1 ELSE k END AS view_value, CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS n_keys FROM {_EVS} e""",
)
def _(t):
    left = F.create_map(F.lit("view"), F.col("k"), F.lit("other"), F.lit(0).cast("long"))
    right = F.create_map(F.col("event_type"), F.col("k") + 1)
    return spark_feed(t, feeds.EV).select("event_id", F.map_concat(left, right).alias("m")).select(
        "event_id", F.col("m")["view"].alias("view_value"), F.size("m").alias("n_keys")
    )


@query(
    "fn25_ordered_distinct",
    f"""SELECT event_id, CASE WHEN k % 3 = k % 5 THEN [event_type, concat('k', k % 3)] ELSE [event_type, concat('k', k % 3), concat('k', k % 5)] END AS xs FROM {_EVS} e""",
)
def _(t):
    return spark_feed(t, feeds.EV).select("event_id", F.array_distinct(_tags()).alias("xs"))


@query("fn26_array_cap", f"SELECT event_id, {_ARR}[1:3] AS xs FROM {_EVS} e")
def _(t):
    return spark_feed(t, feeds.EV).select("event_id", F.slice(_tags(), 1, 3).alias("xs"))


@query("fn27_array_minus", f"SELECT event_id, CASE WHEN k % 5 = k % 3 THEN [concat('k', k % 3)] ELSE [concat('k', k % 3), concat('k', k % 5)] END AS xs FROM {_EVS} e")
def _(t):
    return spark_feed(t, feeds.EV).select("event_id", F.array_except(_tags(), F.array("event_type")).alias("xs"))


@query("fn28_keys", "SELECT event_id, json_keys(props) AS keys, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def _(t):
    props = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", F.map_keys(props).alias("keys"), F.element_at(props, "k").alias("k"))


@query("fn29_joined_names", f"SELECT event_id, array_to_string({_ARR}, ' -> ') AS path FROM {_EVS} e")
def _(t):
    return spark_feed(t, feeds.EV).select("event_id", F.array_join(_tags(), " -> ").alias("path"))


@query("top7_samples", "SELECT vec_id, [round(x, 6) FOR x IN embedding[1:5]] AS first FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: F.round(x, 6)).alias("first"))


@dataclass(frozen=True)
class ScanSettings:
    """Settings of a job: defaults that arguments or the environment may replace."""

    event_type: str = "purchase"
    least: float = 20.0


@query("src7_settings", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value >= 20.0")
def _(t):
    s = ScanSettings()
    return t.spark.sql(
        "SELECT event_id, value FROM {events} WHERE event_type = :event_type AND value >= :least",
        args={"event_type": s.event_type, "least": s.least},
        events=t.events,
    )


_LAYERS = {"args": ["--event-type", "click"], "environ": {"JOB_LEAST": "30.5", "JOB_EVENT_TYPE": "view"}}


@query("src7_layers", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 30.5")
def _(t):
    # the argument wins over the environment, the environment over the default
    made = settings.settings(ScanSettings, _LAYERS["args"], _LAYERS["environ"], "job_")
    return t.spark.sql(
        "SELECT event_id, value FROM {events} WHERE event_type = :event_type AND value >= :least", args=settings.bound(made), events=t.events
    )


@query(
    "set5_unknown_fields",
    "SELECT event_id, list_filter(['k', event_type], lambda x: x NOT IN ('k', 'view')) AS unknown FROM events",
)
def _(t):
    doc = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map("event_type", F.lit(1).cast("long")))
    return t.events.select("event_id", F.array_except(F.map_keys(doc), F.array(F.lit("k"), F.lit("view"))).alias("unknown"))
