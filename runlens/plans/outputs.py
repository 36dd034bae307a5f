"""Sinks: write, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, effects, stock
from ..session import scratch_path
from ..sinks.staging import Staging
from ..sinks import writers
from . import feeds
from .aggregates import _SHADOW
from .feeds import oracle_feed, spark_feed
from .jobs import _ACC, _CTE, _SK, _daily, _items, _log, _rates, _readings, _stations, S
from .registry import query


def summary(t):
    return _daily(t).select("station_id", "name", "region", "day", "mean", "count")


_D = "SELECT station_id, name, region, cast(day AS varchar) AS day, mean, count FROM d"


@query("snk1_csv_report", f"WITH {_CTE} SELECT station_id, name, region, day, mean, count FROM d")
def _(t):
    path = writers.write_report(summary(t), scratch_path(t.spark, "report"), "2024-01-31")
    return t.spark.read.schema(summary(t).schema).option("header", True).csv(path)


@query("snk2_append_and_refresh", f"WITH {_CTE} SELECT x.*, 'append' AS step FROM ({_D}) x UNION ALL SELECT x.*, 'append' FROM ({_D}) x UNION ALL SELECT x.*, 'refresh' FROM ({_D}) x")
def _(t):
    df = summary(t).withColumn("day", F.col("day").cast("string"))
    target = scratch_path(t.spark, "daily_summary")
    writers.save_table(df, target)
    writers.save_table(df, target)
    twice = t.spark.read.parquet(target)
    other = scratch_path(t.spark, "daily_summary")
    writers.save_table(df, other)
    writers.save_table(df, other, full_refresh=True)
    return twice.withColumn("step", F.lit("append")).unionByName(t.spark.read.parquet(other).withColumn("step", F.lit("refresh")))


@query("snk3_json_report", f"WITH {_ACC} SELECT endpoint, requests, errors, error_rate FROM er")
def _(t):
    df = _rates(t).drop("first_line")
    return t.spark.read.schema(df.schema).json(writers.write_json(df, scratch_path(t.spark, "errors")))


@query(
    "snk3_order_report",
    f"WITH {_SK} SELECT supplier, count(*) AS n, sum(qty)::bigint AS units FROM ol WHERE qty <> 0 GROUP BY supplier",
)
def _(t):
    pages = stock.order_pages(stock.order_lines(_items(t)))
    back = t.spark.read.schema(pages.schema).json(writers.write_json(pages, scratch_path(t.spark, "orders")))
    lines = back.select("supplier", F.explode("lines").alias("l"))
    return lines.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("l.qty").alias("units"))


@query(
    "snk4_alert_pages",
    f"""WITH {_CTE}, f AS (SELECT station_id * 100 + day(day) AS pos, station_id, name, mean FROM z WHERE abs(z) > 1.4),
        n AS (SELECT *, row_number() OVER (ORDER BY pos) AS n FROM f)
        SELECT cast(floor((n - 1) / 50) AS bigint) AS page, (SELECT count(*) FROM f) AS count, count(*) AS stations, arg_min(name, n) AS first FROM n GROUP BY 1""",
)
def _(t):
    from ..operators import readings

    flagged = readings.flagged_days(_readings(t), _stations(t), S)
    flagged = flagged.withColumn("pos", F.col("station_id") * 100 + F.dayofmonth("day"))
    out = writers.alert_pages(flagged, "pos", ["station_id", "name", "mean"], page=50)
    body = F.from_json("payload", "struct<count:bigint,stations:array<struct<station_id:bigint,name:string,mean:double>>>")
    return out.select("page", body.alias("b")).select(
        "page", "b.count", F.size("b.stations").cast("long").alias("stations"), F.col("b.stations")[0]["name"].alias("first")
    )


@query(
    "snk4_error_alert",
    f"""WITH {_ACC}, w AS (SELECT * FROM er ORDER BY errors DESC, requests DESC, first_line LIMIT 5)
        SELECT format('Error rate {{:.1f}}% in last night''s traffic', errors / requests * 100) AS subject,
               (SELECT string_agg(concat(endpoint, ': ', errors, ' errors'), chr(10) ORDER BY errors DESC, requests DESC, first_line) FROM w) AS body FROM tot""",
)
def _(t):
    return access.alert(access.endpoint_rates(access.parse(_log(t))))


@query(
    "snk5_staged_append",
    """SELECT 'target' AS side, count(*) AS n, sum(o_orderkey)::bigint AS keys FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'staged', count(*), sum(o_orderkey)::bigint FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')""",
)
def _(t):
    target = scratch_path(t.spark, "orders")
    t.orders.filter("o_orderstatus = 'F'").write.parquet(target)
    area = Staging(t.spark, scratch_path(t.spark, "staging"))
    area.write(t.orders.filter("o_orderstatus = 'O'"), target, "append")
    area.write(t.orders.filter("o_orderstatus = 'P'"), target, "append")
    one = [F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")]
    real = t.spark.read.parquet(target).agg(*one).withColumn("side", F.lit("target"))
    return real.unionByName(area.read(target).agg(*one).withColumn("side", F.lit("staged")))


@query("src9_overlay_read", "SELECT o_orderkey, o_totalprice * 2 AS price FROM orders UNION ALL SELECT o_orderkey, 0.0::double FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    target, other = scratch_path(t.spark, "orders"), scratch_path(t.spark, "other")
    base = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    base.write.parquet(target)
    base.filter("false").unionByName(t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("price"))).write.parquet(other)
    area = Staging(t.spark, scratch_path(t.spark, "staging"))
    area.write(base.withColumn("price", F.col("price") * 2), target)
    # written in this job: the staged copy; not written: the real one
    return area.read(target).unionByName(area.read(other))


@query("snk6_shadow_writes", f"SELECT tbl, count(*) AS n FROM {_SHADOW} w GROUP BY tbl")
def _(t):
    area = Staging(t.spark, scratch_path(t.spark, "staging"))
    s = spark_feed(t, feeds.SQL_CALLS).select(F.col("q").alias("sql"), F.col("k").alias("params"))
    path = area.shadow(s, "main")
    back = t.spark.read.schema("sql string, params long, tbl string").json(path)
    return back.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


@query("snk7_working_copy", "SELECT 'real' AS side, count(*) AS n FROM supplier UNION ALL SELECT 'copy', 2 * count(*) FROM supplier")
def _(t):
    target = scratch_path(t.spark, "supplier")
    t.supplier.write.parquet(target)
    area = Staging(t.spark, scratch_path(t.spark, "staging"))
    area.working_copy(target)
    area.write(t.supplier, target, "append")
    n = F.count(F.lit(1)).alias("n")
    return t.spark.read.parquet(target).agg(n).withColumn("side", F.lit("real")).unionByName(area.read(target).agg(n).withColumn("side", F.lit("copy")))


_OPS = """SELECT * FROM (VALUES (1::bigint, 'write', 'redirected'), (2, 'rename', 'redirected'), (3, 'remove', 'redirected'), (4, 'remove', 'blocked')) v(seq, op, handled)"""


@query("snk8_remove_and_rename", f"SELECT v.*, (SELECT count(*) FROM customer) AS left_rows FROM ({_OPS}) v")
def _(t):
    target = scratch_path(t.spark, "customer")
    t.customer.write.parquet(target)
    area = Staging(t.spark, scratch_path(t.spark, "staging"))
    area.write(t.customer, target + "_a")
    area.rename(target + "_a", target + "_b")
    area.remove(target + "_b")
    area.remove(target)
    left = t.spark.read.parquet(target).agg(F.count(F.lit(1))).scalar()
    return area.ledger().select("seq", "op", "handled", left.alias("left_rows"))


@query("snk9_effect_ledger", f"SELECT kind, op, count(*) AS n FROM {oracle_feed(feeds.IO)} i GROUP BY kind, op")
def _(t):
    path = scratch_path(t.spark, "io_events")
    io = spark_feed(t, feeds.IO)
    # two batches of a job append to the same ledger
    io.filter("kind = 'file'").write.mode("append").parquet(path)
    io.filter("kind <> 'file'").write.mode("append").parquet(path)
    return t.spark.read.schema(io.schema).parquet(path).groupBy("kind", "op").agg(F.count(F.lit(1)).alias("n"))


@query("snk10_live_write", "SELECT count(*) AS n, NULL::varchar AS handled, true AS real FROM nation")
def _(t):
    target = scratch_path(t.spark, "nation")
    area = Staging(t.spark, scratch_path(t.spark, "staging"), live=True)
    area.write(t.nation, target)
    n = t.spark.read.parquet(target).agg(F.count(F.lit(1))).scalar()
    return area.ledger().select("handled", effects.is_real_effect().alias("real"), n.alias("n"))
