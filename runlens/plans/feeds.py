"""What the registered queries read: the given tables, shaped like recordings of job runs.

Each feed is a plain SELECT that Spark and the checking engine both understand, with ``{table}`` where a
table goes, so both sides of a check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .registry import TABLE_NAMES, Tables

# one reading per event: station, hour, temperature in C or F
READINGS = """
SELECT event_id AS pos, user_id AS station_id, date_trunc('hour', ts) AS timestamp,
       CASE WHEN event_type = 'error' AND value < 20 THEN NULL ELSE value END AS temp,
       CASE WHEN event_type = 'click' THEN 'F' ELSE 'C' END AS unit
FROM {events}"""

STATIONS = """
SELECT c_custkey AS station_id, c_name AS name, r_name AS region, c_acctbal AS elevation_m
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

# events with their number k, the run they belong to (200 events each) and the place in it
EV = """
SELECT event_id, ts, user_id, event_type, value,
       cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k,
       cast(floor(event_id / 200) AS bigint) AS run_id, event_id % 200 AS pos
FROM {events}"""

# one access-log line per event; some are garbage
LOG = f"""
SELECT event_id AS line_no,
       CASE WHEN k = 13 THEN concat('garbage ', event_id)
            ELSE concat('10.0.', k, '.', user_id, ' - - [', cast(ts AS date), '] "',
                        CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END, ' /',
                        CASE k % 6 WHEN 0 THEN 'cart' WHEN 1 THEN concat('orders/', event_id)
                             WHEN 2 THEN concat('orders/', event_id, '/items') WHEN 3 THEN 'login'
                             WHEN 4 THEN concat('search?q=', k) ELSE concat('u/', k, 'abc') END,
                        ' HTTP/1.1" ',
                        CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 500 + k % 4
                             WHEN event_type = 'error' THEN 404 ELSE 200 END,
                        ' ', k * 7) END AS value
FROM ({EV}) e"""

# stock: one item per supplier and part that was sold
STOCK = """
SELECT l_suppkey AS supplier, l_partkey AS sku, cast(max(p_size) AS bigint) AS on_hand,
       sum(l_quantity) / 30 AS daily_sales
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
GROUP BY l_suppkey, l_partkey"""

# calls of a run: a tree in which call n has up to three children
NODES = f"""
SELECT run_id, pos + 1 AS node,
       CASE WHEN pos = 0 THEN 'main:<module>' ELSE concat('m', k % 7, ':', event_type) END AS fn,
       CASE WHEN pos = 0 THEN NULL ELSE cast(floor((pos + 2) / 3) AS bigint) END AS parent,
       pos * 2.0E0 AS t_ms, value AS dur_ms, event_id,
       CASE WHEN event_type = 'error' AND k % 10 = 0 THEN concat('KeyError: ', k) END AS raised
FROM ({EV}) e"""

# line events of a run: control moves between the calls 1, 3, 6 and 7 every ten events
_B = "cast(floor(pos / 10) AS bigint)"
_NODE = f"(1 + ({_B} * {_B} + {_B}) % 7)"
LINES = f"""
SELECT run_id, pos + 1 AS seq, {_NODE} AS node, concat('f', {_NODE} % 4, '.py') AS file,
       CASE WHEN k < 80 THEN k % 8 ELSE k % 17 END + 1 AS line, floor(pos / 2) * 2.0E0 AS t_ms, event_type AS var, value, k, event_id,
       CASE WHEN event_type = 'error' AND k % 10 = 0 THEN concat('KeyError: ', k) END AS raised
FROM ({EV}) e"""

# statements of a run: four files of fifteen statements, blocks nested two deep
_I = "cast(floor((o_orderkey % 60) / 4) AS bigint)"
STATEMENTS = f"""
SELECT run_id, concat(file, ':', i + 1) AS stmt, file, i + 1 AS line, i + 1 + odd AS last_line, i AS ord,
       CASE WHEN i = 0 THEN 'for' WHEN i = 4 THEN 'if' WHEN i = 8 THEN 'with' WHEN i = 12 THEN 'while'
            WHEN st = 'F' THEN 'assign' WHEN st = 'O' THEN 'expr' ELSE 'return' END AS kind,
       CASE WHEN i IN (0, 8) THEN NULL WHEN i IN (4, 12) THEN concat(file, ':', i - 3)
            ELSE concat(file, ':', i - i % 4 + 1) END AS parent,
       CASE WHEN i IN (0, 8) THEN NULL WHEN i % 4 = 3 THEN 'else' ELSE 'body' END AS block,
       CASE WHEN i % 4 > 0 AND st = 'F' THEN 'assign' END AS grp,
       CASE WHEN st = 'O' THEN 'project' ELSE 'builtin' END AS call_origin,
       price
FROM (SELECT cast(floor(o_orderkey / 60) AS bigint) AS run_id, {_I} AS i, o_orderkey % 2 AS odd,
             concat('f', o_orderkey % 4, '.py') AS file, o_orderstatus AS st, o_totalprice AS price
      FROM {{orders}}) o"""

# reads and writes of a run, before coalescing
IO = f"""
SELECT run_id, pos + 1 AS seq, {_NODE} AS node,
       CASE WHEN event_type = 'purchase' THEN 'database' WHEN event_type = 'error' THEN 'file' ELSE 'api' END AS kind,
       CASE k % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'connect' WHEN 3 THEN 'insert'
            ELSE 'read-after-write' END AS op,
       concat('t', k % 11) AS target, concat('m', k % 7, ':', event_type) AS fn,
       CASE k % 6 WHEN 1 THEN 'redirected' WHEN 2 THEN 'blocked' WHEN 3 THEN 'shadowed'
            WHEN 4 THEN 'working-copy' WHEN 5 THEN 'read-redirected' END AS handled,
       CASE WHEN k % 3 = 0 THEN k END AS n_rows, CASE WHEN k % 4 = 0 THEN k * 100 END AS n_bytes,
       floor(pos / 2) * 2.0E0 AS t_ms, k, event_id
FROM ({EV}) e"""

# SQL text a job sent to a database
SQL_CALLS = f"""
SELECT run_id, pos + 1 AS seq, event_id, k, event_type,
       CASE k % 14
         WHEN 0 THEN concat('SELECT * FROM "tab', k, '" WHERE id = ', event_id)
         WHEN 1 THEN concat('-- nightly', chr(10), '  INSERT INTO sales.tab', k, ' VALUES (', event_id, ')')
         WHEN 2 THEN concat('/* a', chr(10), 'b */ UPDATE OR IGNORE `tab', k, '` SET x = 1')
         WHEN 3 THEN concat('with c as (select 1) insert into tab', k, ' select * from c')
         WHEN 4 THEN concat('WITH c AS (SELECT 1) SELECT * FROM tab', k)
         WHEN 5 THEN concat('delete from [tab', k, '] where id = ', event_id)
         WHEN 6 THEN concat('CREATE TABLE IF NOT EXISTS tab', k, ' (a int)')
         WHEN 7 THEN 'BEGIN'
         WHEN 8 THEN concat('select name from', chr(9), 'sqlite_master  where k = ', k)
         WHEN 9 THEN concat('REPLACE   INTO tab', k, chr(10), ' VALUES (1)')
         WHEN 10 THEN concat('merge into s.tab', k, ' using u on 1=1')
         WHEN 11 THEN concat('COPY tab', k, ' FROM stdin')
         WHEN 12 THEN ''
         ELSE concat('vacuum tab', k) END AS q
FROM ({EV}) e"""

# text with secrets planted in whole documents
SECRETS = """
SELECT doc_id, lang, source,
       concat(text, ' Authorization: Bearer ', md5(cast(doc_id AS varchar(20))), ' see https://bot:pw', doc_id,
              '@host.example.com/x?token=', md5(lang), '&page=2 key AKIA', upper(md5(source)), ' token = "', doc_id, '"') AS text
FROM {documents}"""

# a source path per page
PATHS = """
SELECT page_id, url,
       concat('/srv/app/', CASE page_id % 7 WHEN 0 THEN 'src/' WHEN 1 THEN '.venv/lib/' WHEN 2 THEN 'pkg/build/'
              WHEN 3 THEN 'etl/' WHEN 4 THEN 'node_modules/x/' WHEN 5 THEN 'a/b/' ELSE '' END,
              CASE page_id % 5 WHEN 0 THEN '__init__.py' WHEN 1 THEN concat('job', page_id, '.py')
                   WHEN 2 THEN 'cache.pyc' WHEN 3 THEN 'data.csv' ELSE 'build' END) AS path
FROM {pages}"""


_TABLE = re.compile(r"\{(" + "|".join(TABLE_NAMES) + r")\}")


def spark_feed(t: Tables, text: str) -> DataFrame:
    names = set(_TABLE.findall(text))
    # every other brace is text (JSON) and has to be doubled
    parts = _TABLE.split(text)
    parts[0::2] = [x.replace("{", "{{").replace("}", "}}") for x in parts[0::2]]
    parts[1::2] = ["{" + x + "}" for x in parts[1::2]]
    return t.spark.sql("".join(parts), **{n: getattr(t, n) for n in names})


def oracle_feed(text: str) -> str:
    """The feed as a bracketed subquery on the table names themselves."""
    return "(" + _TABLE.sub(r"\1", text) + ")"
