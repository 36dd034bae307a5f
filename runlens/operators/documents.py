"""Rule checks over written documents. Findings are rows ``(doc_id, severity, rule, path, detail)``.

Documents are JSON text, one per row. Objects are read as maps from field to raw JSON, so unknown fields and missing
fields stay visible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.published import PARTS, PHASES, STORYBOARD, WALKTHROUGH

# limits of texts and lists, as the published formats have them
_WALK, _SCENE = WALKTHROUGH["properties"], PARTS["scene"]["properties"]
_EXPLANATION = _WALK["explanations"]["others"]["properties"]
WALK_FIELDS = list(_WALK)
TITLE, SUBTITLE, ENTRY = (_WALK[f]["maxLength"] for f in ("title", "subtitle", "entry"))
EXPLANATION = {f: _EXPLANATION[f]["maxLength"] for f in ("title", "text")}
NOTE = _WALK["notes"]["others"]["maxLength"]
SCENES = STORYBOARD["properties"]["scenes"]["maxItems"]
ITEMS, STATS, CHILDREN = (_SCENE[f]["maxItems"] for f in ("items", "stats", "children"))
FINDING = ["doc_id", "severity", "rule", "path", "detail"]
MAP, LIST = "map<string,string>", "array<string>"


def kind_of(schema: Column) -> Column:
    """``storyboard/1`` or ``walkthrough/1``: the part of the schema name behind the first dot."""
    return F.regexp_extract(schema, r"^[^.]+\.(.*)$", 1)


def fields(json: Column) -> Column:
    return F.from_json(json, MAP)


def read_documents(df: DataFrame) -> DataFrame:
    """``doc_id, json`` -> plus ``doc`` (top-level fields) and ``kind`` (by the schema field, not by file name)."""
    doc = fields(F.col("json"))
    return df.withColumn("doc", doc).withColumn("kind", kind_of(F.coalesce(F.col("doc")["schema"], F.lit(""))))


def finding(when: Column, severity: str, rule: str, path: Column | str, detail: Column | str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    detail = F.lit(detail) if isinstance(detail, str) else detail
    row = F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), path.alias("path"), detail.cast("string").alias("detail"))
    return F.when(when, row)


def emit(df: DataFrame, found: list[Column]) -> DataFrame:
    rows = df.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("doc_id", "f.*")


def scenes(docs: DataFrame) -> DataFrame:
    """Scenes of all levels as rows, with their path and depth. Levels are unfolded until there are none left."""
    top = docs.select("doc_id", F.posexplode(F.from_json(F.col("doc")["scenes"], LIST)).alias("i", "raw"))
    level = top.select("doc_id", F.concat(F.lit("scenes["), "i", F.lit("]")).alias("path"), F.lit(0).cast("long").alias("depth"), fields(F.col("raw")).alias("scene"))
    levels = [level]
    while not levels[-1].filter(F.col("scene")["children"].isNotNull()).isEmpty():
        up = levels[-1]
        kids = up.select("doc_id", "path", "depth", F.posexplode(F.from_json(F.col("scene")["children"], LIST)).alias("i", "raw"))
        levels.append(
            kids.select(
                "doc_id", F.concat("path", F.lit(".children["), "i", F.lit("]")).alias("path"), (F.col("depth") + 1).alias("depth"),
                fields(F.col("raw")).alias("scene"),
            )
        )
    return reduce(DataFrame.unionByName, levels)


def check_storyboard_head(docs: DataFrame) -> DataFrame:
    doc = F.col("doc")
    found = [finding(F.col("kind") != "storyboard/1", "problem", "schema", "schema", F.coalesce(doc["schema"], F.lit("missing")))]
    found += [finding(~F.map_contains_key("doc", k), "problem", "required", k, "missing") for k in ("title", "mode", "scenes")]
    return emit(docs, found)


def check_scenes(flat: DataFrame) -> DataFrame:
    s = F.col("scene")
    found = [finding(~F.map_contains_key("scene", k), "problem", "required", F.concat("path", F.lit("." + k)), "missing") for k in ("id", "phase", "title")]
    phase = F.coalesce(s["phase"], F.lit("None"))
    found.append(finding(~phase.isin(PHASES), "problem", "phase", F.concat("path", F.lit(".phase")), phase))
    return emit(flat, found)


def check_duplicate_scenes(flat: DataFrame) -> DataFrame:
    """An id may occur once over all levels; one row per id that occurs more often."""
    ids = flat.select("doc_id", F.col("scene")["id"].alias("id")).filter("id is not null")
    twice = ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.select("doc_id", F.lit("problem").alias("severity"), F.lit("duplicate id").alias("rule"), F.col("id").alias("path"), F.col("n").cast("string").alias("detail"))


def check_scene_limits(docs: DataFrame, flat: DataFrame) -> DataFrame:
    """Published limits: number of scenes, items, stats and children; jump targets must exist."""
    n = F.coalesce(F.size(F.from_json(F.col("doc")["scenes"], LIST)), F.lit(0))
    head = emit(docs, [finding((n < 1) | (n > SCENES), "problem", "scenes", "scenes", n)])

    def count(name: str) -> Column:
        return F.coalesce(F.size(F.from_json(F.col("scene")[name], LIST)), F.lit(0))

    lists = emit(
        flat,
        [
            finding(count(name) > limit, "problem", "too many", F.concat("path", F.lit("." + name)), count(name))
            for name, limit in (("items", ITEMS), ("stats", STATS), ("children", CHILDREN))
        ],
    )
    known = flat.select("doc_id", F.col("scene")["id"].alias("goto")).distinct()
    jumps = flat.select("doc_id", "path", F.col("scene")["goto"].alias("goto")).filter("goto is not null").join(known, ["doc_id", "goto"], "left_anti")
    lost = jumps.select("doc_id", F.lit("problem").alias("severity"), F.lit("goto").alias("rule"), "path", F.col("goto").alias("detail"))
    return head.unionByName(lists).unionByName(lost)


def check_walkthrough_head(docs: DataFrame) -> DataFrame:
    doc = F.col("doc")
    title = F.coalesce(doc["title"], F.lit(""))
    unknown = docs.select("doc_id", F.explode(F.array_except(F.map_keys("doc"), F.array(*[F.lit(f) for f in WALK_FIELDS]))).alias("path"))
    extra = unknown.select("doc_id", F.lit("problem").alias("severity"), F.lit("unknown field").alias("rule"), "path", F.lit("").alias("detail"))
    found = [
        finding(F.col("kind") != "walkthrough/1", "problem", "schema", "schema", F.coalesce(doc["schema"], F.lit("missing"))),
        finding(F.trim(title) == "", "problem", "required", "title", "missing"),
        finding((F.trim(title) != "") & (F.length(title) > TITLE), "problem", "too long", "title", F.length(title)),
        finding(F.length(doc["subtitle"]) > SUBTITLE, "problem", "too long", "subtitle", F.length(doc["subtitle"])),
        finding(F.length(doc["entry"]) > ENTRY, "problem", "too long", "entry", F.length(doc["entry"])),
        finding(fields(doc["explanations"]).isNull(), "problem", "required", "explanations", "missing"),
    ]
    return emit(docs, found).unionByName(extra)


def explanations(docs: DataFrame) -> DataFrame:
    """One row per explained statement: ``doc_id, stmt, e`` with the fields of the explanation."""
    return docs.select("doc_id", F.explode(fields(F.col("doc")["explanations"])).alias("stmt", "raw")).select("doc_id", "stmt", fields(F.col("raw")).alias("e"))


def check_explanations(ex: DataFrame, stmts: DataFrame) -> DataFrame:
    """``stmts(doc_id, stmt)``: statements of the recording a document belongs to."""
    from ..functions.names import is_statement_id

    known = ex.join(stmts.select("doc_id", "stmt").distinct().withColumn("known", F.lit(True)), ["doc_id", "stmt"], "left")
    well = is_statement_id(F.col("stmt"))
    ok = well & F.col("known").isNotNull()
    found = [
        finding(~well, "problem", "statement id", F.col("stmt"), "expected file:line"),
        finding(well & F.col("known").isNull(), "problem", "no such statement", F.col("stmt"), ""),
    ]
    for name, limit in EXPLANATION.items():
        v = F.coalesce(F.col("e")[name], F.lit(""))
        blank = F.trim(v) == ""
        at = F.concat("stmt", F.lit("." + name))
        found.append(finding(ok & blank, "problem", "required", at, "missing"))
        found.append(finding(ok & ~blank & (F.length(v) > limit), "problem", "too long", at, F.length(v)))
    other = F.array_except(F.map_keys("e"), F.array(F.lit("title"), F.lit("text")))
    extra = known.filter(ok).select("doc_id", "stmt", F.explode(other).alias("field")).select(
        "doc_id", F.lit("problem").alias("severity"), F.lit("unknown field").alias("rule"), F.concat_ws(".", "stmt", "field").alias("path"), F.lit("").alias("detail")
    )
    return emit(known, found).unionByName(extra)


def check_notes(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps(doc_id, step)``. A note belongs to a known step and has 1 to 300 characters."""
    notes = docs.select("doc_id", F.explode(fields(F.col("doc")["notes"])).alias("step", "note"))
    known = notes.join(steps.select("doc_id", "step").distinct().withColumn("known", F.lit(True)), ["doc_id", "step"], "left")
    bad = (F.trim("note") == "") | (F.length("note") > NOTE)
    return emit(
        known,
        [
            finding(F.col("known").isNull(), "problem", "no such step", F.col("step"), ""),
            finding(F.col("known").isNotNull() & bad, "problem", "note", F.col("step"), F.length("note")),
        ],
    )


def check_shown(ex: DataFrame, stmts: DataFrame, max_steps: int, ranked: DataFrame) -> DataFrame:
    """Warnings: not shown, inside a group, more explanations than asked for, important statements without one.

    ``stmts(doc_id, stmt, shown, tail)``, ``ranked(doc_id, stmt, place)``."""
    e = ex.select("doc_id", "stmt").join(stmts, ["doc_id", "stmt"])
    seen = emit(
        e,
        [
            finding(~F.col("shown"), "warning", "not shown", F.col("stmt"), ""),
            finding(F.col("shown") & F.col("tail"), "warning", "inside a group", F.col("stmt"), ""),
        ],
    )
    n = ex.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    many = emit(n, [finding(F.col("n") > max_steps, "warning", "many", "explanations", F.col("n"))])
    top = ranked.filter(F.col("place") <= 20).join(ex.select("doc_id", "stmt", F.lit(True).alias("has")), ["doc_id", "stmt"], "left")
    top = top.join(stmts.select("doc_id", "stmt", "tail"), ["doc_id", "stmt"], "left")
    gap = top.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("top"), F.count_if(F.col("has").isNull() & ~F.coalesce(F.col("tail"), F.lit(False))).alias("missing")
    )
    low = emit(gap, [finding(F.col("missing") > F.floor(F.col("top") / 2), "warning", "coverage", "explanations", F.concat_ws("/", "missing", "top"))])
    return seen.unionByName(many).unionByName(low)


class RuleError(RuntimeError):
    """Raised by the gate when problems were found."""


def gate(findings: DataFrame, force: bool = False) -> DataFrame:
    """Any problem stops the job unless it is forced; warnings never do."""
    if not force and not findings.filter("severity = 'problem'").isEmpty():
        raise RuleError("problems found; pass force=True to go on anyway")
    return findings


def verdicts(docs: DataFrame, findings: DataFrame, force: Column) -> DataFrame:
    """One row per document: number of problems and warnings, and whether it may be built."""
    per = findings.groupBy("doc_id").agg(
        F.count_if(F.col("severity") == "problem").alias("problems"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    out = docs.select("doc_id", force.alias("forced")).join(per, "doc_id", "left").na.fill(0, ["problems", "warnings"])
    return out.withColumn("built", (F.col("problems") == 0) | F.col("forced"))


def payload(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Document and recording as one: measured columns from the run, words from the document.

    ``runs(doc_id, mode, entry, status, duration_ms, args, error, n_steps)``."""
    both = docs.join(runs, "doc_id")
    run = F.struct("status", "duration_ms", "args", "error")
    doc = F.col("doc")
    body = F.struct(
        F.coalesce(doc["title"], F.lit("Code walkthrough")).alias("title"), F.coalesce(doc["subtitle"], F.lit("")).alias("subtitle"),
        "mode", F.coalesce(doc["entry"], F.col("entry")).alias("entry"), run.alias("run"), F.col("n_steps"),
    )
    return both.select("doc_id", F.to_json(body).alias("payload"))
