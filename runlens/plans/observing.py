"""Profiles, masks, ledgers and fingerprints of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain, profile, readings

from . import feeds
from .feeds import oracle_feed, spark_feed
from .jobs import _CTE, S
from .registry import query
from .text import sql_redact, sql_short

_CELL = lambda c: f"coalesce({sql_short(sql_redact(c), 24)}, 'None')"


@query(
    "obs1_table_profile",
    f"""SELECT (SELECT count(*) FROM part) AS rows, 6::bigint AS cols, ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'] AS columns,
        ['bigint', 'string', 'string', 'string', 'int', 'double'] AS dtypes,
        (SELECT list([p_partkey::varchar, {_CELL('p_name')}, {_CELL('p_brand')}, {_CELL('p_type')}, p_size::varchar, p_retailprice::varchar] ORDER BY p_partkey)
         FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3)) AS sample_rows""",
)
def _(t):
    return profile.table_profile(t.part, ["p_partkey"])


@query(
    "obs2_column_profile",
    """SELECT count(*) AS rows, 'o_orderpriority' AS name, 'string' AS dtype, list(o_orderpriority ORDER BY o_orderkey)[1:5] AS sample FROM orders""",
)
def _(t):
    return profile.column_profile(t.orders, "o_orderpriority", ["o_orderkey"])


@query("obs3_array_profile", "SELECT vec_id, len(embedding) AS n, [round(x, 6) FOR x IN embedding[1:3]] AS sample FROM embeddings")
def _(t):
    s = profile.array_summary(F.col("embedding"))
    return t.embeddings.select("vec_id", s.alias("s")).select(
        "vec_id", F.col("s.len").alias("n"), F.transform("s.sample", lambda x: F.round(x.cast("float"), 6)).alias("sample")
    )


@query(
    "obs4_map_profile",
    f"""SELECT event_id, 3::bigint AS len, ['k', 'api_token', 'type'] AS keys, [k::varchar, '***', event_type] AS vals FROM {oracle_feed(feeds.EV)} e""",
)
def _(t):
    m = F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("api_token"), F.lit("abc"), F.lit("type"), F.col("event_type"))
    return spark_feed(t, feeds.EV).select("event_id", profile.map_summary(m).alias("s")).select(
        "event_id", "s.len", "s.keys", F.col("s.values").alias("vals")
    )


@query(
    "obs5_struct_profile",
    f"SELECT event_id, ['k', 'event_type', 'password'] AS fields, [k::varchar, event_type, '***'] AS vals FROM {oracle_feed(feeds.EV)} e",
)
def _(t):
    s = F.struct("k", "event_type", F.col("event_type").alias("password"))
    return spark_feed(t, feeds.EV).select("event_id", s.alias("x")).select(
        "event_id", profile.struct_summary(F.col("x"), ["k", "event_type", "password"]).alias("s")
    ).select("event_id", "s.fields", F.col("s.values").alias("vals"))


@query("obs6_text_profile", f"SELECT doc_id, length(text) AS len, {sql_short(sql_redact('text'), 100)} AS value FROM {oracle_feed(feeds.SECRETS)} s")
def _(t):
    return spark_feed(t, feeds.SECRETS).select("doc_id", profile.string_summary(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("obs7_binary_profile", "SELECT page_id, octet_length(encode(html)) AS len FROM pages")
def _(t):
    return t.pages.select("page_id", profile.binary_summary(F.encode("html", "UTF-8")).alias("s")).select("page_id", "s.len")


@query(
    "obs8_http_profile",
    f"""SELECT page_id, 200 + page_id % 5 AS status, 'text/html' AS content_type, {sql_redact(sql_short("concat(url, '?token=', md5(url))", 140))} AS url FROM pages""",
)
def _(t):
    s = profile.http_summary(F.col("page_id") % 5 + 200, F.lit("text/html"), F.concat("url", F.lit("?token="), F.md5("url")))
    return t.pages.select("page_id", s.alias("s")).select("page_id", "s.*")


_LEDGER = f"""
c AS (SELECT 0 AS seq, 'input' AS step, (SELECT count(*) FROM r0) AS n UNION ALL SELECT 1, 'celsius', (SELECT count(*) FROM r1)
      UNION ALL SELECT 2, 'drop_missing', (SELECT count(*) FROM r2) UNION ALL SELECT 3, 'in_range', (SELECT count(*) FROM r3)
      UNION ALL SELECT 4, 'first_per_time', (SELECT count(*) FROM r4)),
lg AS (SELECT a.seq::bigint AS seq, a.step, b.n AS rows_in, a.n AS rows_out, a.n - b.n AS delta, 0::bigint AS cols_delta FROM c a JOIN c b ON b.seq = a.seq - 1)"""


@query("obs9_ledger", f"WITH {_CTE}, {_LEDGER} SELECT *, true AS timed FROM lg")
def _(t):
    out = chain.ledger(spark_feed(t, feeds.READINGS), readings.cleaning_steps(S))
    return out.withColumn("timed", F.col("pass_ms") >= 0).drop("pass_ms")


@query("obs9_staged_ledger", f"WITH {_CTE}, {_LEDGER} SELECT *, true AS timed FROM lg")
def _(t):
    _, out = chain.staged_ledger(spark_feed(t, feeds.READINGS), readings.cleaning_steps(S))
    return out.withColumn("timed", F.col("ms") >= 0).drop("ms")


@query(
    "obs10_schema_change",
    f"""WITH {_CTE} SELECT * FROM (
        SELECT 'pos' AS name, 'bigint' AS type_before, (SELECT count(*) FROM r0) AS filled_before, 'bigint' AS type_after, (SELECT count(*) FROM e) AS filled_after, 'kept' AS change
        UNION ALL SELECT 'station_id', 'bigint', (SELECT count(*) FROM r0), 'bigint', (SELECT count(*) FROM e), 'kept'
        UNION ALL SELECT 'timestamp', 'timestamp', (SELECT count(*) FROM r0), 'string', (SELECT count(*) FROM e), 'retyped'
        UNION ALL SELECT 'temp', 'double', (SELECT count(temp) FROM r0), 'double', (SELECT count(temp) FROM e), 'kept'
        UNION ALL SELECT 'unit', 'string', (SELECT count(*) FROM r0), NULL, NULL, 'removed'
        UNION ALL SELECT 'name', NULL, NULL, 'string', (SELECT count(name) FROM e), 'added'
        UNION ALL SELECT 'region', NULL, NULL, 'string', (SELECT count(region) FROM e), 'added'
        UNION ALL SELECT 'elevation_m', NULL, NULL, 'double', (SELECT count(elevation_m) FROM e), 'added') x""",
)
def _(t):
    before = spark_feed(t, feeds.READINGS)
    after = readings.enrich(readings.apply_steps(before, readings.cleaning_steps(S)), spark_feed(t, feeds.STATIONS))
    return profile.schema_change(before, after.drop("unit").withColumn("timestamp", F.col("timestamp").cast("string")))


@query("obs11_fingerprint", "SELECT count(*) AS rows, true AS same_content, false AS same_after_change FROM lineitem")
def _(t):
    a = profile.fingerprint(t.lineitem).select("rows", F.struct("rows", "mix", "sum").alias("a"))
    b = profile.fingerprint(t.lineitem.repartition("l_partkey")).select(F.struct("rows", "mix", "sum").alias("b"))
    c = profile.fingerprint(t.lineitem.withColumn("l_tax", F.when(F.col("l_linenumber") == 1, 0.5).otherwise(F.col("l_tax")))).select(
        F.struct("rows", "mix", "sum").alias("c")
    )
    both = profile.one_row([a, b, c])
    return both.select("rows", (F.col("a") == F.col("b")).alias("same_content"), (F.col("a") == F.col("c")).alias("same_after_change"))


@query(
    "obs12_mask",
    f"SELECT doc_id, '***' AS auth_token, md5({sql_redact('text')}) AS digest FROM {oracle_feed(feeds.SECRETS)} s",
)
def _(t):
    df = spark_feed(t, feeds.SECRETS).select("doc_id", F.col("source").alias("auth_token"), "text")
    return profile.mask(df).select("doc_id", "auth_token", F.md5("text").alias("digest"))


@query(
    "obs13_job_summary",
    f"""WITH {_CTE}, {_LEDGER} SELECT arg_min(rows_in, seq) AS rows_in, arg_max(rows_out, seq) AS rows_out, count(*) AS stages,
        (SELECT count(*) FROM {oracle_feed(feeds.IO)} i WHERE handled IN ('redirected', 'blocked', 'shadowed', 'working-copy') AND op NOT IN ('read', 'connect', 'mkdir')) AS held,
        (SELECT count(*) FROM {oracle_feed(feeds.IO)} i WHERE coalesce(handled, '') NOT IN ('redirected', 'blocked', 'shadowed', 'working-copy', 'read-redirected')
         AND op NOT IN ('read', 'connect', 'read-after-write')) AS real FROM lg""",
)
def _(t):
    stages = chain.ledger(spark_feed(t, feeds.READINGS), readings.cleaning_steps(S))
    return profile.job_summary(stages, spark_feed(t, feeds.IO))


@query(
    "udf5_summaries",
    f"""SELECT doc_id::varchar AS doc_id, concat('{{"len":', length(lang), ',"value":"', lang, '"}}') AS lang, '***' AS secret FROM documents""",
)
def _(t):
    df = t.documents.select("doc_id", "lang", F.col("source").alias("secret"))
    return profile.summarise_columns(df, ["doc_id", "lang", "secret"])


@query(
    "obs14_schema_profile",
    """SELECT * FROM (SELECT 'o_orderkey' AS name, 'bigint' AS dtype, 0 AS pos, count(o_orderkey) AS filled FROM orders
       UNION ALL SELECT 'o_custkey', 'bigint', 1, count(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', 'string', 2, count(o_orderstatus) FROM orders
       UNION ALL SELECT 'o_totalprice', 'double', 3, count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderpriority', 'string', 4, count(o_orderpriority) FROM orders) x""",
)
def _(t):
    # names and types come from the plan, counts from the footers of the files: no row is read
    lazy = t.orders.drop("o_orderdate")
    return profile.schema_profile(lazy).join(profile.footer_counts(t.spark, t.file("orders")).select("name", "filled"), "name")
