"""User functions: chains of steps, functions per row, aggregates, table functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import LOG_LINE
from ..operators import access, readings, userfuncs
from . import feeds
from .feeds import spark_feed
from .jobs import _ACC, _CTE, _SK, S, _items, _log
from .registry import query


@query("udf1_step_chain", f"WITH {_CTE} SELECT count(*) AS n, count(DISTINCT station_id) AS stations FROM r4")
def _(t):
    clean = readings.apply_steps(spark_feed(t, feeds.READINGS), readings.cleaning_steps(S))
    return clean.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("station_id").alias("stations"))


def _needed(on_hand: int, daily: float) -> int:
    short = daily * 7 - on_hand
    return max(10, round(short)) if short > 0 else 0


@query("udf2_per_row", f"WITH {_SK} SELECT supplier, sku, qty FROM ol")
def _(t):
    return _items(t).select("supplier", "sku", userfuncs.per_row(_needed, "long")("on_hand", "daily_sales").alias("qty"))


def _count(record: dict):
    yield "requests", record["endpoint"]
    if record["status"] >= 500:
        yield "errors", record["endpoint"]


@query(
    "udf3_counters",
    f"WITH {_ACC} SELECT 'requests' AS counter, endpoint AS key, requests AS n FROM er UNION ALL SELECT 'errors', endpoint, errors FROM er WHERE errors > 0",
)
def _(t):
    from ..functions.text import endpoint

    requests = access.parse(_log(t)).select(endpoint(F.col("path")).alias("endpoint"), "status")
    return userfuncs.counted(requests, _count, ["endpoint", "status"])


_LINE = re.compile(LOG_LINE.replace("(?U)", ""))


def _parse(record: dict):
    m = _LINE.search(record["value"])
    if m:
        yield {"line_no": record["line_no"], "path": m.group(3), "status": int(m.group(4))}


@query("udf4_table_function", f"WITH {_ACC} SELECT line_no, path, status::bigint AS status FROM rq")
def _(t):
    return userfuncs.table_function(_log(t), _parse, "line_no long, path string, status long")
