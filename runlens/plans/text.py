"""Scalar functions over text and SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, sql_text, text
from . import feeds
from .feeds import oracle_feed, spark_feed
from .registry import query

_SEC = oracle_feed(feeds.SECRETS)
_SQLC = oracle_feed(feeds.SQL_CALLS)
# the patterns as the checking engine wants them: ASCII words, \1 for a group
_P = [(p.replace("(?U)", ""), r.replace("$1", r"\1")) for p, r in text.SECRET_VALUES]


def sql_redact(col: str) -> str:
    for p, r in _P:
        col = f"regexp_replace({col}, '{p}', '{r}', 'g')"
    return col


def sql_short(col: str, n: int) -> str:
    return f"CASE WHEN length({col}) > {n} THEN concat(substring({col}, 1, {n - 1}), '…') ELSE {col} END"


SECRET = text.SECRET_NAME


@query("fn1_redact", f"SELECT doc_id, md5({sql_redact('text')}) AS digest, {sql_redact('text[-200:]')} AS tail FROM {_SEC} s")
def _(t):
    df = spark_feed(t, feeds.SECRETS)
    tail = F.expr("substring(text, -200)")
    return df.select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"), text.redact(tail).alias("tail"))


@query(
    "fn2_secret_name",
    f"""SELECT name, regexp_matches(name, '{SECRET}') AS secret, count(*) AS n FROM
        (SELECT concat(CASE k % 5 WHEN 0 THEN 'API_KEY' WHEN 1 THEN 'author' WHEN 2 THEN 'n_tokens' WHEN 3 THEN 'rows'
         ELSE 'region' END, k) AS name FROM {oracle_feed(feeds.EV)} e) GROUP BY 1, 2""",
)
def _(t):
    name = F.expr(
        "concat(CASE k % 5 WHEN 0 THEN 'API_KEY' WHEN 1 THEN 'author' WHEN 2 THEN 'n_tokens' WHEN 3 THEN 'rows' ELSE 'region' END, k)"
    )
    df = spark_feed(t, feeds.EV).select(name.alias("name"))
    return df.groupBy("name", text.is_secret_name(F.col("name")).alias("secret")).agg(F.count(F.lit(1)).alias("n"))


@query("fn3_short", f"SELECT doc_id, {sql_short('text', 120)} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", text.short(F.col("text")).alias("text"))


@query("fn4_cell", f"""SELECT conv_id, turn, {sql_short(sql_redact('text'), 24)} AS text,
                       {sql_short(sql_redact("cast(conv_id AS varchar)"), 24)} AS conv FROM conversations""")
def _(t):
    return t.conversations.select(
        "conv_id", "turn", text.cell(F.col("text")).alias("text"), text.cell(F.col("conv_id")).alias("conv")
    )


_STRIP = rf"trim(regexp_replace(q, '{sql_text.COMMENTS}', ''), chr(10) || chr(9) || ' ')"
_WORD = r"lower(regexp_extract({0}, '^\s*(\S*)', 1))"


def _sql_kind(col: str) -> str:
    reads = ", ".join(f"'{w}'" for w in sql_text.READ_WORDS + [""])
    word = _WORD.format(col)
    return (
        rf"CASE WHEN {word} = 'with' THEN CASE WHEN regexp_matches({col}, '(?i){sql_text.WITH_WRITE}') "
        f"THEN 'write' ELSE 'read' END WHEN {word} IN ({reads}) THEN 'read' ELSE 'write' END"
    )


def _sql_unquote(col: str) -> str:
    return f"trim({col}, '\"`[]')"


def _sql_written(col: str) -> str:
    return _sql_unquote(f"nullif(regexp_extract({col}, '(?i){sql_text.WRITE_FORM}', 1), '')")


def _sql_from(col: str) -> str:
    return _sql_unquote(f"nullif(regexp_extract({col}, '(?i)\\bfrom\\s+([\\w.\"`\\[\\]]+)', 1), '')")


def _sql_noise(col: str) -> str:
    words = ", ".join(f"'{w}'" for w in sql_text.NOISE_WORDS)
    cat = sql_text.CATALOG_TABLES.replace("(?U)", "")
    return f"({_WORD.format(col)} IN ({words}) OR regexp_matches({col}, '{cat}'))"


@query("fn10_strip_comments", f"SELECT event_id, {_STRIP} AS text FROM {_SQLC} s")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.strip_comments(F.col("q")).alias("text"))


@query("fn11_sql_kind", f"SELECT event_id, {_sql_kind('x')} AS kind FROM (SELECT *, {_STRIP} AS x FROM {_SQLC} s)")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.kind(F.col("q")).alias("kind"))


@query("fn12_sql_verb", f"SELECT event_id, CASE WHEN {_WORD.format('x')} = '' THEN 'write' ELSE {_WORD.format('x')} END AS verb FROM (SELECT *, {_STRIP} AS x FROM {_SQLC} s)")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.verb(sql_text.strip_comments(F.col("q"))).alias("verb"))


@query("fn13_sql_table", f"SELECT event_id, {_sql_written('x')} AS tbl FROM (SELECT *, {_STRIP} AS x FROM {_SQLC} s)")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.written_table(sql_text.strip_comments(F.col("q"))).alias("tbl"))


@query("fn14_first_from", f"SELECT event_id, {_sql_from('q')} AS tbl FROM {_SQLC} s")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.first_from(F.col("q")).alias("tbl"))


@query("fn15_noise", f"SELECT event_id, {_sql_noise('x')} AS noise FROM (SELECT *, {_STRIP} AS x FROM {_SQLC} s)")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.is_noise(sql_text.strip_comments(F.col("q"))).alias("noise"))


_METHOD = "CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'HEAD' WHEN 'signup' THEN 'Options' WHEN 'purchase' THEN 'POST' ELSE 'delete' END"


@query(
    "fn16_http_class",
    f"SELECT event_id, CASE WHEN upper({_METHOD}) IN ('GET', 'HEAD', 'OPTIONS') THEN 'read' ELSE 'write' END AS direction FROM events",
)
def _(t):
    return t.events.select("event_id", sql_text.http_direction(F.expr(_METHOD)).alias("direction"))


# one call name, mode and target per event
_CALLS = f"""
SELECT event_id,
       CASE k % 16 WHEN 0 THEN 'open' WHEN 1 THEN 'pd.read_csv' WHEN 2 THEN 'pd.read_sql' WHEN 3 THEN 'cur.fetchall'
         WHEN 4 THEN 'df.to_sql' WHEN 5 THEN 'smtp.send_message' WHEN 6 THEN 'json.dump' WHEN 7 THEN 'Requests.get'
         WHEN 8 THEN 'requests.post' WHEN 9 THEN 'cur.execute' WHEN 10 THEN 'yaml.load' WHEN 11 THEN 'os.environ.get'
         WHEN 12 THEN 'sqlite3.connect' WHEN 13 THEN 'math.sqrt' WHEN 14 THEN 'path.open' ELSE 'd.get' END AS call,
       CASE WHEN k % 3 = 0 THEN 'r' WHEN k % 3 = 1 THEN 'ab' END AS mode,
       CASE WHEN event_type = 'view' THEN ' select 1' WHEN event_type = 'click' THEN 'Insert into t values (1)' END AS target
FROM ({feeds.EV}) e"""


def _lst(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _plain_calls() -> str:
    """A case for each name whose direction depends on nothing but, for some names, their owner."""
    owners = {n: own for found, own in names.OWNERS.items() for n in found}
    cases = []
    for (direction, kind), found in names.CALLS.items():
        if direction in ("read", "write"):
            for n in found:
                needs = f" AND o IN {_lst(owners[n])}" if n in owners else ""
                cases.append(f"WHEN l = '{n}'{needs} THEN '{direction}/{kind}'")
    return "\n       ".join(cases)


_LAST = "split_part(call, '.', -1)"
_OWNER = "CASE WHEN contains(call, '.') THEN lower(split_part(call, '.', 1)) ELSE '' END"
_CALL_SQL = f"""SELECT event_id, call,
  CASE WHEN call IN ('open', 'io.open') OR (l = 'open' AND o IN ('path', 'p', 'file', 'io'))
         THEN CASE WHEN regexp_matches(coalesce(mode, 'r'), '[wax+]') THEN 'write/file' ELSE 'read/file' END
       {_plain_calls()}
       WHEN l IN ('execute', 'executemany', 'executescript')
         THEN CASE WHEN regexp_matches(coalesce(target, ''), '{names.WRITE_SQL}') THEN 'write/database' ELSE 'read/database' END
       WHEN l = 'getenv' OR call IN {_lst(names.ENV_CALLS)} THEN 'read/config'
       WHEN l IN ('connect', 'create_engine') THEN 'connect/database' END AS io
FROM (SELECT *, {_LAST} AS l, {_OWNER} AS o FROM {oracle_feed(_CALLS)} c)"""


@query("fn17_call_class", _CALL_SQL)
def _(t):
    io = names.call_class(F.col("call"), F.col("mode"), F.col("target"))
    return spark_feed(t, _CALLS).select(
        "event_id", "call", F.when(io.isNotNull(), F.concat(io["direction"], F.lit("/"), io["kind"])).alias("io")
    )


_SETTING = """CASE k % 6 WHEN 0 THEN concat('os.getenv("K', k, '")') WHEN 1 THEN cast(k AS varchar(9)) WHEN 2 THEN concat('''v', k, '''')
  WHEN 3 THEN 'json.load(open(p))' WHEN 4 THEN concat('BASE + ', k) ELSE 'yaml.safe_load(t)' END"""


@query(
    "fn18_setting_origin",
    rf"""SELECT event_id, CASE WHEN regexp_matches(x, '^\s*(-?[0-9][0-9._]*|''[^'']*''|"[^"]*"|True|False|None)\s*$') THEN 'literal'
        WHEN regexp_matches(x, '\b(getenv|environ)\b') THEN 'environment'
        WHEN regexp_matches(x, '\b(json\.load|yaml|toml|configparser|load_dotenv|read_text)\b') THEN 'config file'
        ELSE 'expression' END AS origin FROM (SELECT event_id, {_SETTING} AS x FROM {oracle_feed(feeds.EV)} e)""",
)
def _(t):
    return spark_feed(t, feeds.EV).select("event_id", names.setting_origin(F.expr(_SETTING.replace("''''", "\"'\"").replace("'''v'", "\"'v\""))).alias("origin"))


_IMP = "SELECT event_id, CASE WHEN k % 4 = 0 THEN 'etl' WHEN k % 4 = 1 THEN 'json' WHEN k % 4 = 2 THEN 'lib' ELSE concat('x', k) END AS top FROM (" + feeds.EV + ") e"


@query(
    "fn19_import_class",
    f"""SELECT event_id, top, CASE WHEN top = 'etl' THEN 'project' WHEN top = 'json' THEN 'stdlib'
        WHEN top = 'lib' THEN 'third_party' ELSE 'missing' END AS kind FROM {oracle_feed(_IMP)} i""",
)
def _(t):
    # the three lists as tables, the first that knows the name decides
    known = t.spark.createDataFrame([("etl", 0), ("json", 1), ("lib", 2)], "top string, prio int")
    df = spark_feed(t, _IMP).join(known, "top", "left")
    return df.select(
        "event_id", "top",
        names.import_class(F.col("prio") == 0, F.col("prio") == 1, F.col("prio") == 2).alias("kind"),
    )


@query(
    "fn20_split_id",
    r"""SELECT event_id, split_part(fn, ':', 1) AS module, CASE WHEN contains(fn, ':') THEN substr(fn, instr(fn, ':') + 1) ELSE '' END AS qualname,
       regexp_matches(concat(fn, ':', t_ms::bigint), '^.+:[0-9]+(#[0-9]+)?$') AS is_stmt, regexp_matches(fn, '^.+:[0-9]+(#[0-9]+)?$') AS fn_is_stmt FROM """
    + oracle_feed(feeds.NODES) + " n",
)
def _(t):
    fn = F.col("fn")
    return spark_feed(t, feeds.NODES).select(
        "event_id", names.module_of(fn).alias("module"), names.qualname_of(fn).alias("qualname"),
        names.is_statement_id(F.concat(fn, F.lit(":"), F.col("t_ms").cast("long"))).alias("is_stmt"),
        names.is_statement_id(fn).alias("fn_is_stmt"),
    )


@query(
    "fn21_module_name",
    rf"""SELECT page_id, regexp_replace(replace(CASE WHEN regexp_matches(p, '[^/]\.[^./]+$') THEN regexp_replace(p, '\.[^./]+$', '') ELSE p END, '/', '.'),
        '\.__init__$', '') AS module FROM (SELECT page_id, regexp_replace(path, '^/srv/app/', '') AS p FROM {oracle_feed(feeds.PATHS)} x)""",
)
def _(t):
    return spark_feed(t, feeds.PATHS).select("page_id", names.module_name(F.col("path"), "/srv/app").alias("module"))


@query("fn22_file_name", r"SELECT page_id, regexp_replace(url, '[^\w.-]', '_', 'g') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("fn23_one_line", rf"SELECT event_id, trim(regexp_replace(q, '\s+', ' ', 'g')) AS text FROM {_SQLC} s")
def _(t):
    return spark_feed(t, feeds.SQL_CALLS).select("event_id", sql_text.one_line(F.col("q")).alias("text"))


@query("fn30_database_label", f"""SELECT event_id, {sql_redact("substring(split_part(x, ' ', 1), 1, 60)")} AS label FROM
    (SELECT event_id, concat('postgres://u', k, ':pw', event_id, '@db', k, '/', event_type, ' sslmode=off') AS x FROM {oracle_feed(feeds.EV)} e)""")
def _(t):
    dsn = F.expr("concat('postgres://u', k, ':pw', event_id, '@db', k, '/', event_type, ' sslmode=off')")
    return spark_feed(t, feeds.EV).select("event_id", text.database_label(dsn).alias("label"))


@query("fn31_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("at"))


@query("fn32_first_line", r"SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r\n|\n|\r')[1] AS first FROM documents")
def _(t):
    return t.documents.select("doc_id", text.first_line(F.col("text")).alias("first"))


@query(
    "fn33_json_safe",
    "SELECT event_id, concat('{\"id\":', event_id, ',\"type\":\"', event_type, '\",\"tags\":[\"', event_type, '\",\"', k, '\"]}') AS params FROM "
    + oracle_feed(feeds.EV) + " e",
)
def _(t):
    row = F.struct(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"),
        F.array("event_type", F.col("k").cast("string")).alias("tags"),
    )
    return spark_feed(t, feeds.EV).select("event_id", F.to_json(row).alias("params"))


@query("fn34_line_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS part FROM documents")
def _(t):
    return t.documents.select("doc_id", text.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("part"))


_OUT = """SELECT event_id, CASE WHEN event_type = 'click' THEN k % 3 END AS code,
          CASE WHEN event_type = 'error' THEN 'ValueError' END AS etype, concat('bad https://u:p', k, '@h/?token=x', k) AS msg FROM (""" + feeds.EV + ") e"


@query(
    "fn35_outcome",
    f"""SELECT event_id, CASE WHEN etype IS NOT NULL THEN 'error' WHEN coalesce(code, 0) <> 0 THEN 'exit' ELSE 'ok' END AS status,
        CASE WHEN etype IS NULL THEN coalesce(code, 0) END AS exit_code,
        CASE WHEN etype IS NOT NULL THEN concat(etype, ': ', {sql_short(sql_redact('msg'), 400)}) END AS error FROM {oracle_feed(_OUT)} o""",
)
def _(t):
    return spark_feed(t, _OUT).select("event_id", names.outcome(F.col("code"), F.col("etype"), F.col("msg")).alias("o")).select("event_id", "o.*")


@query(
    "fn36_effect_status",
    f"""SELECT event_id, CASE WHEN coalesce(handled, '') IN ('redirected', 'working-copy', 'shadowed') THEN 'sandboxed'
        WHEN handled = 'blocked' THEN 'blocked' ELSE 'real' END AS status FROM {oracle_feed(feeds.IO)} i""",
)
def _(t):
    return spark_feed(t, feeds.IO).select("event_id", names.effect_status(F.col("handled")).alias("status"))


@query(
    "fn37_written_rows",
    f"""SELECT event_id, CASE WHEN kind = 'write' AND k % 2 = 0 THEN k WHEN kind = 'write' THEN 1 END AS n FROM
        (SELECT event_id, k, {_sql_kind('x')} AS kind FROM (SELECT *, {_STRIP} AS x FROM {_SQLC} s))""",
)
def _(t):
    params = F.expr("CASE WHEN k = 0 THEN array() ELSE sequence(1, k) END")
    return spark_feed(t, feeds.SQL_CALLS).select(
        "event_id", sql_text.written_rows(F.col("q"), params, F.col("k") % 2 == 0).alias("n")
    )
