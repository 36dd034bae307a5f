"""The three jobs, staging, rules and functions on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from runlens.functions import names, numbers, sql_text, text
from runlens.operators import access, chain, documents, lookups, profile, readings, stock
from runlens.session import scratch_path
from runlens.sinks import writers
from runlens.sinks.staging import Staging
from runlens.sources import readers


def col(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


# ---- readings

STATIONS = [("S1", "North", "R1", 10.0), ("S2", "South", "R1", 20.0), ("S3", "East", "R2", 5.0)]


def stations(spark):
    return spark.createDataFrame(STATIONS, "station_id string, name string, region string, elevation_m double")


def at(hour, day=1):
    return dt.datetime(2026, 10, day, hour)


def test_cleaning_counts(spark):
    rows = [
        (0, "S1", at(0), 10.0, "C"), (1, "S1", at(0), 10.0, "C"),  # sent again
        (2, "S1", at(1), 50.0, "F"), (3, "S1", at(2), None, "C"), (4, "S1", at(3), float("nan"), "C"),
        (5, "S1", at(4), 999.0, "C"), (6, None, at(5), 1.0, "C"), (7, "S9", at(5), 1.0, "C"), (8, "S1", at(6), -40.0, "C"),
    ]
    df = spark.createDataFrame(rows, "pos long, station_id string, timestamp timestamp, temp double, unit string")
    steps = readings.cleaning_steps(readings.ReadingSettings())
    got = [(r.step, r.rows_in, r.rows_out) for r in chain.ledger(df, steps).orderBy("seq").collect()]
    assert got == [("celsius", 9, 9), ("drop_missing", 9, 6), ("in_range", 6, 5), ("first_per_time", 5, 4)]
    clean = readings.apply_steps(df, steps)
    assert sorted((r.pos, r.temp) for r in clean.collect()) == [(0, 10.0), (2, 10.0), (7, 1.0), (8, -40.0)]
    daily = readings.daily_summary(readings.enrich(clean, stations(spark))).collect()
    # the unknown station has no name and disappears
    assert [(r.station_id, r["min"], r["max"], r["mean"], r["count"]) for r in daily] == [("S1", -40.0, 10.0, -6.67, 3)]


def test_z_uses_the_sample_deviation(spark):
    rows = [("R1", 1.0), ("R1", 2.0), ("R1", 6.0), ("R2", 5.0), ("R3", 4.0), ("R3", 4.0)]
    got = readings.with_z(spark.createDataFrame(rows, "region string, mean double")).collect()
    z = sorted((r.region, r["mean"], None if r.z is None else round(r.z, 4)) for r in got)
    assert z == [("R1", 1.0, -0.7559), ("R1", 2.0, -0.378), ("R1", 6.0, 1.1339), ("R2", 5.0, None), ("R3", 4.0, None), ("R3", 4.0, None)]


def test_hot_station(spark):
    """A third of the readings come from one station and one hour."""
    df = spark.range(3000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "S1").otherwise(F.concat(F.lit("X"), F.col("id") % 50)).alias("station_id"),
        F.lit(at(0)).alias("timestamp"), F.lit(1.0).alias("temp"),
    )
    kept = readings.first_per_time(df)
    assert kept.count() == 51 and kept.filter("station_id = 'S1'").first().pos == 0


# ---- access log


def line(path, status=200, ip="10.0.0.1"):
    return f'{ip} - - [01/Oct/2026] "GET {path} HTTP/1.1" {status} 512'


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_error_rates(spark):
    df = lines(spark, [line("/cart"), line("/orders/12?x=1", 500), "garbage", line("/orders/7/items"), line("/orders/9"), line("/login", 503), line("/12ab")])
    assert tuple(access.rejected(df).first()) == (6, 1)
    rates = access.by_requests(access.endpoint_rates(access.parse(df))).collect()
    assert [(r.endpoint, r.requests, r.errors, r.error_rate) for r in rates] == [
        ("/orders/:id", 2, 1, 0.5), ("/cart", 1, 0, 0.0), ("/orders/:id/items", 1, 0, 0.0), ("/login", 1, 1, 1.0), ("/:idab", 1, 0, 0.0),
    ]
    out = access.alert(access.endpoint_rates(access.parse(df))).collect()
    assert out[0].subject == "Error rate 33.3% in last night's traffic"
    assert out[0].body.splitlines()[:2] == ["/orders/:id: 1 errors", "/login: 1 errors"]


def test_no_alert_below_the_threshold(spark):
    rates = access.endpoint_rates(access.parse(lines(spark, [line("/a")] * 5)))
    assert access.alert(rates).count() == 0
    empty = access.total_rate(access.endpoint_rates(access.parse(lines(spark, ["x"])))).first()
    assert (empty.requests, empty.errors, empty.rate) == (0, 0, 0.0)


# ---- stock


def test_half_is_rounded_to_even(spark):
    items = spark.createDataFrame(
        [("a", 0, 7.5, "X"), ("b", 100, 1.0, "X"), ("c", 6, 1.0, "Y"), ("d", 0, 7.642857142857143, "Y")],
        "sku string, on_hand int, daily_sales double, supplier string",
    )
    got = {r.sku: r.qty for r in items.withColumn("qty", numbers.reorder_quantity(F.col("on_hand"), F.col("daily_sales"))).collect()}
    assert got == {"a": 52, "b": 0, "c": 10, "d": 54}  # 52.5 -> 52, 53.5 -> 54
    lines = stock.order_lines(items.withColumn("pos", F.monotonically_increasing_id()))
    assert tuple(stock.order_totals(lines).first()) == (3, 2, 116)


def test_orders_of_a_big_supplier_are_paged(spark):
    lines = spark.range(25).select(F.col("id").alias("sku"), F.lit(1).cast("long").alias("qty"), F.lit("X").alias("supplier"))
    pages = stock.order_pages(lines, page=10).orderBy("page").collect()
    assert [len(p.lines) for p in pages] == [10, 10, 5]
    assert [x.sku for p in pages for x in p.lines] == list(range(25))


def test_strict_csv_stops_on_a_bad_number(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sku,on_hand,daily_sales,supplier\na,1,2.5,X\nb,many,1.0,X\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_stock(spark, str(tmp_path)).collect()


def test_csv_times_and_empty_cells(spark, tmp_path):
    (tmp_path / "r.csv").write_text("station_id,timestamp,temp,unit\nS1,2026-10-01T03:00:00,,C\nS1,2026-10-01T04:00:00,7.5,F\n")
    got = [(r.timestamp.hour, r.temp) for r in readers.read_readings(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(3, None), (4, 7.5)]


# ---- functions


@pytest.mark.parametrize(
    "value, want",
    [
        ("Authorization: Bearer abcdefgh12345", "Authorization: Bearer ***"),
        ("postgres://u:secret@h/db", "postgres://u:***@h/db"),
        ("key sk-abcdefghijkl1 end", "key *** end"),
        ("/x?token=abc&page=2", "/x?token=***&page=2"),
        ('token = "abcdef"', 'token = "abcdef"'),  # free text is left alone
        ("ésk-abcdefghijklmn", "ésk-abcdefghijklmn"),  # a letter before it, also one outside ASCII
    ],
)
def test_redact(spark, value, want):
    assert col(spark, value, text.redact) == want


def test_secret_names_are_not_anchored(spark):
    for name, want in [("API_KEY", True), ("author", True), ("n_tokens", True), ("rows", False)]:
        assert col(spark, name, text.is_secret_name) is want


def test_short(spark):
    assert col(spark, "a" * 120, text.short) == "a" * 120
    assert col(spark, "é" * 121, text.short) == "é" * 119 + "…"


@pytest.mark.parametrize(
    "sql, kind, table",
    [
        ("-- c\n insert or replace into \"a\".b values (1)", "write", 'a".b'),
        ("with x as (select 1) delete from t", "write", None),
        ("with x as (select ')') select 1", "read", None),
        ("", "read", None),
        ("vacuum t", "write", None),
        ("create table if not exists s.t (a int)", "write", "s.t"),
    ],
)
def test_sql_text(spark, sql, kind, table):
    assert col(spark, sql, sql_text.kind) == kind
    assert col(spark, sql, lambda c: sql_text.written_table(sql_text.strip_comments(c))) == table


def test_module_names(spark):
    for path, want in [("/r/a/b.py", "a.b"), ("/r/pkg/__init__.py", "pkg"), ("/r/x", "x")]:
        assert col(spark, path, lambda c: names.module_name(c, "/r")) == want


def test_excluded_folders(spark):
    assert col(spark, "/r/build/x.py", names.in_excluded_folder) is True
    assert col(spark, "/r/src/build", names.in_excluded_folder) is False  # the last part is the file


def test_read_after_write_needs_a_whole_word(spark):
    w = spark.createDataFrame([(1, 5, "s.Tab1"), (1, 2, "tab2")], "run_id long, seq long, tbl string")
    r = spark.createDataFrame(
        [(1, 3, "select * from TAB1"), (1, 6, "select * from TAB1"), (1, 7, "from tab12"), (1, 8, "from tab2, tab2_old"), (2, 9, "from tab2")],
        "run_id long, seq long, sql string",
    )
    assert sorted((x.seq, x.tbl) for x in lookups.read_after_write(r, w).collect()) == [(6, "s.Tab1"), (8, "tab2")]


# ---- observation


def test_profile_hides_secrets(spark):
    df = spark.createDataFrame([(1, "u:/ https://a:b@c/", "x" * 40)], "id long, url string, api_token string")
    p = profile.table_profile(df, ["id"]).first()
    assert (p.rows, p.cols, p.columns) == (1, 3, ["id", "url", "api_token"])
    # names of table columns are not tested, cell values are redacted and short
    assert p.sample_rows == [["1", "u:/ https://a:***@c/", "x" * 23 + "…"]]
    assert profile.mask(df).first().api_token == "***"
    assert profile.mask(df, allow=("api_token",)).first().api_token == "x" * 40


def test_schema_profile_reads_no_row(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("a row was read")).alias("x"), F.lit(1).alias("y"))
    assert [(r.name, r.dtype) for r in profile.schema_profile(broken).collect()] == [("x", "void"), ("y", "int")]


def test_profile_of_an_empty_table(spark):
    p = profile.table_profile(spark.createDataFrame([], "a long, b string"), ["a"]).first()
    assert (p.rows, p.cols, p.sample_rows) == (0, 2, [])


# ---- staging


def content(spark, path):
    return profile.fingerprint(spark.read.parquet(path)).first()


def test_safe_mode_leaves_the_target_alone(spark):
    target = scratch_path(spark, "t")
    spark.range(10).write.parquet(target)
    before = content(spark, target)
    area = Staging(spark, scratch_path(spark, "area"))
    area.write(spark.range(10, 15), target, "append")
    assert area.read(target).count() == 15
    area.write(spark.range(3), target)
    assert area.read(target).count() == 3
    assert area.rename(target, target + "_2") and not area.remove(target)
    assert content(spark, target) == before
    handled = [(r.op, r.handled) for r in area.ledger().orderBy("seq").collect()]
    assert handled == [("write", "redirected"), ("read", "read-redirected"), ("write", "redirected"), ("read", "read-redirected"), ("rename", "redirected"), ("remove", "blocked")]


def test_staged_layers_are_no_copies(spark):
    """What is appended, renamed or kept privately is stored once; a removed table loses the job's own files only."""
    target = scratch_path(spark, "t")
    spark.range(10).write.parquet(target)
    before = content(spark, target)
    area = Staging(spark, scratch_path(spark, "area"))
    assert area.working_copy(target).count() == 10
    added = [area.write(spark.range(n, n + 2), target, "append") for n in (10, 12)]
    assert [spark.read.parquet(p).count() for p in added] == [2, 2]
    assert sorted(r.id for r in area.working_copy(target).collect()) == list(range(14))
    area.rename(target, target + "_2")
    assert area.read(target + "_2").count() == 14 and area.read(target).count() == 10
    assert set(area.seen(target + "_2").inputFiles()) >= set(spark.read.parquet(target).inputFiles())
    assert area.remove(target + "_2") and not any(writers.exists(spark, p) for p in added)
    assert content(spark, target) == before
    with pytest.raises(FileNotFoundError):
        area.rename(target + "_none", target + "_3")


def test_full_refresh_replaces(spark):
    target = scratch_path(spark, "t")
    assert writers.save_table(spark.range(4).toDF("a"), target) == 4
    assert writers.save_table(spark.range(2).toDF("a"), target) == 2
    assert spark.read.parquet(target).count() == 6
    assert writers.save_table(spark.range(3).toDF("a"), target, full_refresh=True) == 3
    assert spark.read.parquet(target).count() == 3


# ---- rules


def walk(spark, body):
    docs = documents.read_documents(spark.createDataFrame([(1, body)], "doc_id long, json string"))
    stmts = spark.createDataFrame([(1, "m.py:1", True, False), (1, "m.py:2", True, True), (1, "m.py:3", False, False)], "doc_id long, stmt string, shown boolean, tail boolean")
    steps = spark.createDataFrame([(1, "s1")], "doc_id long, step string")
    ranked = spark.createDataFrame([(1, "m.py:1", 1)], "doc_id long, stmt string, place long")
    ex = documents.explanations(docs)
    return (
        documents.check_walkthrough_head(docs)
        .unionByName(documents.check_explanations(ex, stmts))
        .unionByName(documents.check_notes(docs, steps))
        .unionByName(documents.check_shown(ex, stmts, 150, ranked))
    )


HEAD = '"schema":"x.walkthrough/1","title":"T"'
GOOD = '{"title":"a","text":"b"}'


@pytest.mark.parametrize(
    "body, want",
    [
        (f'{{{HEAD},"explanations":{{"m.py:1":{GOOD}}}}}', []),
        (f'{{{HEAD},"explanations":{{"m.py:1":{GOOD},"m.py:99":{GOOD}}}}}', [("problem", "no such statement", "m.py:99")]),
        (f'{{{HEAD},"explanations":{{"m.py:1":{{"title":"{"x" * 61}"}}}}}}', [("problem", "required", "m.py:1.text"), ("problem", "too long", "m.py:1.title")]),
        (f'{{{HEAD},"extra":1,"explanations":{{"m.py:1":{GOOD}}},"notes":{{"s9":"n"}}}}', [("problem", "no such step", "s9"), ("problem", "unknown field", "extra")]),
        (f'{{{HEAD},"explanations":{{"m.py:1":{GOOD},"m.py:2":{GOOD}}}}}', [("warning", "inside a group", "m.py:2")]),
        (f'{{{HEAD},"explanations":{{"m.py:3":{GOOD}}}}}', [("warning", "coverage", "explanations"), ("warning", "not shown", "m.py:3")]),
    ],
)
def test_walkthrough_rules(spark, body, want):
    found = walk(spark, body)
    assert sorted((r.severity, r.rule, r.path) for r in found.collect()) == want
    if any(x[0] == "problem" for x in want):
        with pytest.raises(documents.RuleError):
            documents.gate(found)
    else:
        documents.gate(found)
    documents.gate(found, force=True)


def test_closing_tag_in_text_survives(spark):
    body = '{"schema":"x.walkthrough/1","title":"a </script> b"}'
    docs = documents.read_documents(spark.createDataFrame([(1, body)], "doc_id long, json string"))
    runs = spark.createDataFrame([(1, "run", "m.py", "ok", 1.5, ["x"], None, 3)], "doc_id long, mode string, entry string, status string, duration_ms double, args array<string>, error string, n_steps long")
    out = documents.payload(docs, runs).select(F.get_json_object("payload", "$.title").alias("t"), F.get_json_object("payload", "$.run.error").alias("e")).first()
    assert (out.t, out.e) == ("a </script> b", None)


def test_watch_list(spark):
    used = spark.createDataFrame([(1, "boto3"), (1, "sqlalchemy"), (1, "numpy")], "run_id long, library string")
    assert [r.library for r in lookups.watched_libraries(used).collect()] == ["boto3"]


def test_warnings_parse_a_document_once(spark):
    from conftest import DATA
    from runlens.plans import all_queries

    plan = all_queries()["chk7_warnings"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan  # the whole texts were read for a narrow table, before
