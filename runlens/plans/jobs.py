"""The three data jobs, step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import half_even, reorder_quantity
from ..functions.text import endpoint, percent
from ..operators import access, readings, stock
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

S = readings.ReadingSettings(low=0.0, high=250.0, z=1.4)

_R = oracle_feed(feeds.READINGS)
_ST = oracle_feed(feeds.STATIONS)
_CTE = f"""
r0 AS {_R}, st AS {_ST},
r1 AS (SELECT pos, station_id, timestamp, 'C' AS unit,
              CASE WHEN unit = 'F' THEN (temp - 32) * 5 / 9 ELSE temp END AS temp FROM r0),
r2 AS (SELECT * FROM r1 WHERE temp IS NOT NULL AND station_id IS NOT NULL),
r3 AS (SELECT * FROM r2 WHERE temp >= 0 AND temp <= 250),
r4 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY pos) = 1),
e AS (SELECT r4.*, st.name, st.region, st.elevation_m FROM r4 LEFT JOIN st USING (station_id)),
d AS (SELECT station_id, name, region, cast(timestamp AS date) AS day, min(temp) AS min, max(temp) AS max,
             round_even(sum(cast(temp AS decimal(28,8)))::double / count(temp) * 100, 0) / 100 AS mean,
             count(temp) AS count
      FROM e WHERE name IS NOT NULL AND region IS NOT NULL GROUP BY ALL),
z AS (SELECT *, (mean - avg(mean) OVER w) / nullif(stddev_samp(mean) OVER w, 0) AS z
      FROM d WINDOW w AS (PARTITION BY region))
"""


def _readings(t):
    return spark_feed(t, feeds.READINGS)


def _stations(t):
    return spark_feed(t, feeds.STATIONS)


def _daily(t):
    clean = readings.apply_steps(_readings(t), readings.cleaning_steps(S))
    return readings.daily_summary(readings.enrich(clean, _stations(t)))


@query("prj1_units", f"WITH {_CTE} SELECT pos, unit, round(temp, 6) AS temp FROM r1")
def _(t):
    return readings.celsius(_readings(t)).select("pos", "unit", F.round("temp", 6).alias("temp"))


@query("prd1_drop_missing", f"WITH {_CTE} SELECT pos, station_id, round(temp, 6) AS temp FROM r2")
def _(t):
    df = readings.drop_missing(readings.celsius(_readings(t)))
    return df.select("pos", "station_id", F.round("temp", 6).alias("temp"))


@query("prd2_range", f"WITH {_CTE} SELECT pos, station_id, round(temp, 6) AS temp FROM r3")
def _(t):
    df = readings.apply_steps(_readings(t), readings.cleaning_steps(S)[:3])
    return df.select("pos", "station_id", F.round("temp", 6).alias("temp"))


@query("win2_dedupe", f"WITH {_CTE} SELECT pos, station_id, timestamp FROM r4")
def _(t):
    return readings.apply_steps(_readings(t), readings.cleaning_steps(S)).select("pos", "station_id", "timestamp")


_LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    "win2_lineitem",
    f"""SELECT {_LI} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
        l_linestatus) = 1""",
)
def _(t):
    from ..operators.ordered import first_k

    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus"]
    return first_k(t.lineitem, ["l_orderkey", "l_linenumber"], order, 1).select(*_LI.split(", "))


@query("jn1_enrich", f"WITH {_CTE} SELECT pos, station_id, name, region, elevation_m FROM e")
def _(t):
    clean = readings.apply_steps(_readings(t), readings.cleaning_steps(S))
    return readings.enrich(clean, _stations(t)).select("pos", "station_id", "name", "region", "elevation_m")


@query("agg1_daily", f"WITH {_CTE} SELECT station_id, name, region, day, round(min, 6) AS min, round(max, 6) AS max, mean, count FROM d")
def _(t):
    return _daily(t).withColumns({"min": F.round("min", 6), "max": F.round("max", 6)})


@query("win1_zscore", f"WITH {_CTE} SELECT station_id, day, region, mean, round(z, 6) AS z FROM z")
def _(t):
    return readings.with_z(_daily(t)).select("station_id", "day", "region", "mean", F.round("z", 6).alias("z"))


@query("prd5_absolute_z", f"WITH {_CTE} SELECT station_id, day, round(z, 6) AS z FROM z WHERE abs(z) > 1.4")
def _(t):
    return readings.anomalies(_daily(t), S).select("station_id", "day", F.round("z", 6).alias("z"))


@query(
    "wx_anomalies",
    f"""WITH {_CTE} SELECT station_id, name, region, day, round(min, 6) AS min, round(max, 6) AS max, mean, count,
        round(z, 6) AS z FROM z WHERE abs(z) > 1.4""",
)
def _(t):
    flagged = readings.flagged_days(_readings(t), _stations(t), S)
    return flagged.withColumns({c: F.round(c, 6) for c in ("min", "max", "z")})


@query("prj2_payload", f"WITH {_CTE} SELECT station_id, name, mean FROM z WHERE abs(z) > 1.4")
def _(t):
    return readings.flagged_days(_readings(t), _stations(t), S).select("station_id", "name", "mean")


@query(
    "fn7_day",
    "SELECT event_id, cast(ts AS date) AS day, strftime(ts, '%Y-%m-%d') AS day_text FROM events",
)
def _(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"), F.to_date("ts").cast("string").alias("day_text"))


@query(
    "fn8_rounding",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_extendedprice / 8 * 100, 0) / 100 AS cents,
       round_even(l_quantity / 2, 0) AS units FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        half_even(F.col("l_extendedprice") / 8, 2).alias("cents"),
        half_even(F.col("l_quantity") / 2).alias("units"),
    )


# ---- access log

_LOG = oracle_feed(feeds.LOG)
_PAT = r"(\S+) .* \"(\w+) (\S+) [^\"]*\" (\d{3}) (\d+)".replace('\\"', '"')
_ACC = f"""
lg AS {_LOG},
rq AS (SELECT line_no, regexp_extract(value, '{_PAT}', 1) AS ip, regexp_extract(value, '{_PAT}', 2) AS method,
              regexp_extract(value, '{_PAT}', 3) AS path, cast(regexp_extract(value, '{_PAT}', 4) AS integer) AS status,
              regexp_extract(value, '{_PAT}', 5) AS bytes
       FROM lg WHERE regexp_matches(value, '{_PAT}')),
ep AS (SELECT regexp_replace(split_part(path, '?', 1), '/[0-9]+', '/:id', 'g') AS endpoint, count(*) AS requests,
              count(*) FILTER (WHERE status >= 500) AS errors, min(line_no) AS first_line
       FROM rq GROUP BY 1),
er AS (SELECT *, round_even(errors / requests * 10000, 0) / 10000 AS error_rate FROM ep),
tot AS (SELECT coalesce(sum(requests), 0)::bigint AS requests, coalesce(sum(errors), 0)::bigint AS errors FROM er)
"""


def _log(t):
    return spark_feed(t, feeds.LOG)


def _rates(t):
    return access.endpoint_rates(access.parse(_log(t)))


@query("fn5_log_line", f"WITH {_ACC} SELECT * FROM rq")
def _(t):
    return access.parse(_log(t))


@query(
    "prd3_regex_gate",
    f"WITH {_ACC} SELECT count(*) FILTER (WHERE regexp_matches(value, '{_PAT}')) AS parsed, "
    f"count(*) FILTER (WHERE NOT regexp_matches(value, '{_PAT}')) AS rejected FROM lg",
)
def _(t):
    return access.rejected(_log(t))


@query("prd4_server_errors", f"WITH {_ACC} SELECT line_no, path, status FROM rq WHERE status >= 500")
def _(t):
    return access.parse(_log(t)).filter(F.col("status") >= 500).select("line_no", "path", "status")


@query("agg2_error_rate", f"WITH {_ACC} SELECT endpoint, requests, errors, error_rate FROM er")
def _(t):
    return _rates(t).drop("first_line")


@query("prj4_rate", f"WITH {_ACC} SELECT endpoint, error_rate FROM er")
def _(t):
    return _rates(t).select("endpoint", "error_rate")


@query("agg3_total_rate", f"WITH {_ACC} SELECT requests, errors, errors / requests AS rate FROM tot")
def _(t):
    return access.total_rate(_rates(t))


@query(
    "agg3_total_rate_empty",
    f"WITH {_ACC} SELECT coalesce(sum(requests), 0)::bigint AS requests, 0::bigint AS errors, 0.0::double AS rate FROM er WHERE requests < 0",
)
def _(t):
    return access.total_rate(_rates(t).filter("requests < 0"))


@query(
    "prd7_decision",
    f"WITH {_ACC} SELECT requests, errors, errors / requests AS rate, errors / requests > 0.05 AS taken FROM tot",
)
def _(t):
    return access.decision(_rates(t))


@query(
    "top1_endpoints",
    f"WITH {_ACC} SELECT row_number() OVER (ORDER BY requests DESC, first_line) AS place, endpoint, requests FROM er",
)
def _(t):
    from ..operators.ordered import scan

    # ranked by ranges of all endpoints, so no task sorts all of them
    ranked = _rates(t).withColumn("fewer", -F.col("requests"))
    return scan(ranked, [], ["fewer", "first_line"], row_number="place", ranges=True).select("place", "endpoint", "requests")


@query("top2_worst", f"WITH {_ACC} SELECT endpoint, errors FROM er ORDER BY errors DESC, requests DESC, first_line LIMIT 5")
def _(t):
    return access.worst(_rates(t)).select("endpoint", "errors")


@query(
    "fn9_percent",
    f"WITH {_ACC} SELECT endpoint, format('{{:.1f}}%', round_even(error_rate * 1000, 0) / 10) AS text FROM er",
)
def _(t):
    return _rates(t).select("endpoint", percent(half_even(F.col("error_rate"), 3)).alias("text"))


@query(
    "fn6_endpoint",
    r"""SELECT page_id, regexp_replace(split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1), '/[0-9]+', '/:id', 'g')
       AS endpoint FROM pages""",
)
def _(t):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return t.pages.select("page_id", endpoint(path).alias("endpoint"))


# ---- stock

_SK = f"""
it AS {oracle_feed(feeds.STOCK)},
ol AS (SELECT *, CASE WHEN daily_sales * 7 - on_hand > 0
                      THEN cast(greatest(10.0, round_even(daily_sales * 7 - on_hand, 0)) AS bigint) ELSE 0 END AS qty FROM it)
"""


def _items(t):
    return spark_feed(t, feeds.STOCK)


@query("prj3_reorder", f"WITH {_SK} SELECT supplier, sku, on_hand, qty FROM ol")
def _(t):
    return _items(t).select("supplier", "sku", "on_hand", reorder_quantity(F.col("on_hand"), F.col("daily_sales")).alias("qty"))


@query("prd6_positive", f"WITH {_SK} SELECT supplier, sku, qty FROM ol WHERE qty <> 0")
def _(t):
    return stock.order_lines(_items(t)).select("supplier", "sku", "qty")


@query(
    "agg4_orders",
    f"""WITH {_SK}, p AS (SELECT *, cast(floor((row_number() OVER (PARTITION BY supplier ORDER BY sku) - 1) / 1000) AS bigint)
        AS page FROM ol WHERE qty <> 0)
        SELECT supplier, page, list({{'sku': sku, 'qty': qty}} ORDER BY sku) AS lines FROM p GROUP BY supplier, page""",
)
def _(t):
    return stock.order_pages(stock.order_lines(_items(t)))


@query(
    "agg19_totals",
    f"""WITH {_SK} SELECT count(*) AS lines, count(DISTINCT supplier) AS suppliers, sum(qty)::bigint AS units
        FROM ol WHERE qty <> 0""",
)
def _(t):
    return stock.order_totals(stock.order_lines(_items(t)))
