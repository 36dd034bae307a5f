"""Lazy scans, recordings, document folders, settings, caps, import classes."""

import json
import os
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from runlens.operators import lookups, steps
from runlens.operators.ordered import capped
from runlens.plans import all_queries
from runlens.session import scratch_root
from runlens.sources import readers, recordings
from runlens.sources.settings import SettingError, settings


def test_recordings_are_parsed_once(spark, tmp_path):
    """Tables read their columns of parsed recordings: none of them parses the text again."""
    fn = {"id": "m:f", "name": "f", "branches": [{"line": 3, "condition": "q > 1", "has_else": True, "body_lines": [3, 4]}], "loops": []}
    lines = [{"entry": "a", "modules": {"m": {"functions": {"f": fn}}}, "io": {"env_vars": {"V": {"set": True}}}}, {"entry": "b", "io": {"env_vars": {}}}, {"entry": "a"}]
    (tmp_path / "log.json").write_text("\n".join([*map(json.dumps, lines), "no recording"]))
    tables = recordings.bundle_tables(recordings.read_bundles(spark, str(tmp_path), one_per_file=False))
    for name in ("runs", "branches", "loops", "env_vars"):
        assert "from_json" not in tables[name]._jdf.queryExecution().optimizedPlan().toString(), name
    runs = {r.run_id: r.entry for r in tables["runs"].collect()}
    assert sorted(map(str, runs.values())) == ["None", "a", "a", "b"]
    branch, = tables["branches"].collect()
    assert (runs[branch.run_id], branch.fn, branch.line, branch.condition, branch.has_else, branch.body_lines) == ("a", "m:f", 3, "q > 1", True, [3, 4])
    assert tables["loops"].count() == 0
    assert [(runs[r.run_id], r.name, r.set, r.secret) for r in tables["env_vars"].collect()] == [("a", "V", True, None)]


def test_recordings_take_little_room(spark, tmp_path):
    """Recordings of rows, as text and parsed, take a few times the room of the rows: about 3 times here, 17 times as plain text."""
    k = F.col("id")
    rows = spark.range(60_000, numPartitions=1).select(
        F.floor(k / 4).alias("l_orderkey"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("l_partkey"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400)).alias("l_suppkey"),
        (k % 4).cast("int").alias("l_linenumber"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).cast("double").alias("l_quantity"),
        F.element_at(F.array(*map(F.lit, "ANR")), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)).cast("int") + 1).alias("l_returnflag"),
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))

    def room(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(str(folder).removeprefix("file:")) for f in files if f.startswith("part-"))

    before = room(scratch_root(spark))
    out = all_queries()["src5_more_tables"](spark, str(tmp_path))
    assert room(scratch_root(spark)) - before < 5 * room(tmp_path / "lineitem.parquet")
    assert out.where("tbl in ('branches', 'loops')").count() == 60_000


def test_input_order_is_lazy(spark, tmp_path):
    words = [f"w{i}" for i in range(5000)]
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("\n".join(words[n * 1000 : (n + 1) * 1000 + (2000 if n == 2 else 0)]) + "\n")
    root = scratch_root(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        assert [r.value for r in lines.orderBy("line_no").collect()] == words
        first = lines.groupBy().agg(F.min_by("value", "line_no"), F.max_by("value", "line_no")).first()
        assert tuple(first) == ("w0", "w4999")
        after = set(os.listdir(root)) if os.path.isdir(root) else set()
        assert after == before
        dense = readers.numbered(lines, "line_no").orderBy("line_no").collect()
        assert [(r.line_no, r.value) for r in dense] == list(enumerate(words))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_equal_recordings_stay_apart(spark, tmp_path):
    run = {
        "created": "c", "entry": "e", "trace": {"nodes": [{"id": 1, "fn": "m:f"}]}, "io": {"env_vars": {"A": {"set": True, "secret": False}}, "shadow_tables": {"t": {"rows": 3, "file": "f"}}},
        "statements": {"a:1": {"file": "a", "names": {"x": {"kind": "constant", "value": {"type": "int", "value": 3}}, "y": {"kind": "local"}}}},
        "modules": {"m": {"functions": {"f": {"id": "m:f", "branches": [{"line": 2, "condition": "x", "has_else": True, "body_lines": [3]}], "loops": [{"line": 5, "code": "for"}]}}}},
    }
    (tmp_path / "a.json").write_text((json.dumps(run) + "\n") * 2)
    tables = recordings.bundle_tables(recordings.read_bundles(spark, str(tmp_path), one_per_file=False))
    assert len(tables) == 20 and tables["runs"].select("run_id").distinct().count() == 2
    assert tables["nodes"].join(tables["env_vars"], "run_id").count() == 2
    got = {r.name: (r.kind, r.value) for r in tables["stmt_names"].collect()}
    assert got == {"x": ("constant", '{"type":"int","value":3}'), "y": ("local", None)}
    assert [(r.fn, r.line, r.condition, r.has_else, r.body_lines) for r in tables["branches"].distinct().drop("run_id").withColumn("run", F.lit(1)).distinct().collect()] == [("m:f", 2, "x", True, [3])]
    assert tables["loops"].count() == 2 and tables["shadow_tables"].agg(F.sum("rows")).first()[0] == 6


def test_documents_are_told_by_their_schema(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text('{\n"schema": "x.walkthrough/1", "title": "T"}')
    (tmp_path / "sub" / "walkthrough.json").write_text('{"schema": "x.storyboard/1"}')
    (tmp_path / "b.json").write_text("not JSON")
    (tmp_path / "c.json").write_text("")
    got = {os.path.basename(r.doc_id): r.kind for r in recordings.read_document_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "walkthrough/1", "walkthrough.json": "storyboard/1", "b.json": ""}


@dataclass(frozen=True)
class Job:
    date: str = "2026-01-01"
    least: float = 1.5
    limit: int = 3
    full_refresh: bool = False
    alerts: bool = True


def test_settings():
    assert settings(Job, [], {}) == Job()
    assert settings(Job, ["--full-refresh", "--no-alerts", "--limit=7", "--date", "x"], {}) == Job("x", 1.5, 7, True, False)
    env = {"J_LEAST": "2", "J_ALERTS": "no", "LIMIT": "9", "J_DATE": "env"}
    assert settings(Job, ["--date", "arg"], env, "j_") == Job("arg", 2.0, 3, False, False)
    for args, environ in ((["--limit", "x"], {}), (["--other"], {}), (["date"], {}), (["--limit"], {}), ([], {"LIMIT": "1.5"}), ([], {"ALERTS": "maybe"})):
        with pytest.raises(SettingError):
            settings(Job, args, environ)


def test_caps_over_tables(spark):
    a = spark.range(30).select((F.col("id") % 3).alias("run"), "id")
    b = spark.range(8).select((F.col("id") % 4).alias("run"), F.col("id").alias("seq"))
    kept, flags = capped({"a": (a, ["id"], 9), "b": (b.filter("run > 0"), [F.desc("seq")], 1)}, ["run"])
    assert {(r.run, r.id) for r in kept["a"].collect()} == {(i % 3, i) for i in range(27)} and kept["b"].count() == 3
    assert {r.run: (r.truncated, r.over) for r in flags.collect()} == {0: (True, ["a"]), 1: (True, ["a", "b"]), 2: (True, ["a", "b"]), 3: (True, ["b"])}
    _, none = capped({"a": (a, ["id"], 10), "b": (b, ["seq"], 2)}, ["run"])
    assert {(r.truncated, tuple(r.over)) for r in none.collect()} == {(False, ())}


def test_import_classes(spark):
    imports = spark.createDataFrame([(1, "json"), (1, "csv.x"), (2, "csv.x"), (1, "pyspark.sql"), (1, "nowhere"), (2, "etl.a")], "run_id long, target string")
    project = spark.createDataFrame([(1, "csv"), (1, "csv.x"), (2, "etl.clean")], "run_id long, module string")
    got = {(r.run_id, r.target): r.kind for r in lookups.import_classes(imports, project, lookups.library_names(spark)).collect()}
    assert got == {(1, "json"): "stdlib", (1, "csv.x"): "project", (2, "csv.x"): "stdlib", (1, "pyspark.sql"): "third_party", (1, "nowhere"): "missing", (2, "etl.a"): "project"}


def test_loop_summary_rows(spark):
    from test_steps import kept

    lines, stmts, closure, k = kept(spark, 20)
    counts = lines.groupBy("run_id", "node", "line").agg(F.count(F.lit(1)).alias("n"))
    spans = steps.loop_spans(k, closure, stmts, counts)
    hidden = steps.hidden_by_loops(k, spans, span=8)
    changes = k.select("run_id", "seq", F.concat(F.lit("v"), "line").alias("var"), F.col("t_ms").alias("value")).withColumn("deleted", F.col("var") == "v2")
    got = steps.loop_summaries(spans, hidden, k, changes).collect()
    last = {r.stmt: r.t_ms for r in k.filter("seq < 81").orderBy("seq").collect()}
    assert [(r.start, r.node, r.stmt, r.iterations, r.detailed, r.hidden, r.changes) for r in got] == [
        (1, 1, "a:1", 20, 20, 57, {"v1": last["a:1"], "v3": last["a:3"]})
    ]
    _, stmts, closure, short = kept(spark, 3)
    spans = steps.loop_spans(short, closure, stmts, counts.limit(0))
    assert steps.loop_summaries(spans, steps.hidden_by_loops(short, spans), short, changes).count() == 0
