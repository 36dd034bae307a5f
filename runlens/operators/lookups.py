"""Joins that look something up: names, call targets, modules, focus, watched libraries, earlier writes."""

from __future__ import annotations

import sys
from importlib.metadata import packages_distributions

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Libraries whose writes are not seen, with what they are.
WATCHED = [
    ("boto3", "AWS SDK calls (S3 uploads, etc.)"),
    ("google.cloud.storage", "Google Cloud Storage"),
    ("google.cloud.bigquery", "BigQuery"),
    ("azure.storage.blob", "Azure Blob Storage"),
    ("pyarrow", "pyarrow native file writes (e.g. parquet)"),
    ("snowflake.connector", "Snowflake"),
    ("pymongo", "MongoDB"),
    ("redis", "Redis"),
    ("kafka", "Kafka"),
    ("confluent_kafka", "Kafka"),
    ("paramiko", "SSH/SFTP"),
    ("ftplib", "FTP"),
    ("mysql.connector", "MySQL (connector)"),
    ("pyodbc", "ODBC databases"),
    ("sqlalchemy", "SQLAlchemy (writes are intercepted at the driver level)"),
]
LOCALS = ".<locals>."


def watched_libraries(used: DataFrame) -> DataFrame:
    """Used libraries on the watch list. The list has fifteen rows, so it is sent to every task."""
    watch = used.sparkSession.createDataFrame([w for w in WATCHED if w[0] != "sqlalchemy"], "library string, what string")
    return used.select("run_id", "library").distinct().join(F.broadcast(watch), "library")


def in_focus(rows: DataFrame, files: list[str], functions: list[tuple[str, str]]) -> DataFrame:
    """Rows of the chosen files, or of the chosen functions and the functions nested in them."""
    spark = rows.sparkSession
    keep = F.col("file").isin(files) if files else F.lit(False)
    parts = F.split("qual", LOCALS.replace(".", r"\."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), LOCALS))
    wanted = spark.createDataFrame([(f, q) for f, q in functions], "file string, __q string")
    per_file = wanted.groupBy("file").agg(F.collect_set("__q").alias("__qs"))  # as long as the request
    out = rows.join(per_file, "file", "left")
    return out.filter(keep | F.coalesce(F.arrays_overlap(prefixes, F.col("__qs")), F.lit(False))).drop("__qs")


def unresolved_items(items: DataFrame, functions: DataFrame) -> DataFrame:
    """Requested items (a module, a function name, or ``module:qualname``) that match nothing."""
    names = functions.select(
        F.explode(F.array("module", "name", "qualname", F.concat_ws(":", "module", "qualname"))).alias("item")
    ).distinct()
    return items.join(names, "item", "left_anti")


def read_after_write(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Reads whose text mentions, as a whole word in any case, a table written earlier in the run and held back.

    The text is cut into words, so the join is an equality join on (run, word); a hot run spreads over its words."""
    tables = writes.groupBy("run_id", "tbl").agg(F.min("seq").alias("first_write"))
    tables = tables.withColumn("word", F.lower(F.element_at(F.split("tbl", r"\."), -1)))
    words = reads.select("run_id", "seq", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(r"(?U)(\w+)"), 1))).alias("word"))
    return words.join(tables, ["run_id", "word"]).filter(F.col("seq") > F.col("first_write")).select("run_id", "seq", "tbl", "first_write")


def _candidate(prio: int, when: Column, value: Column) -> Column:
    return F.when(when, F.struct(F.lit(prio).alias("prio"), value.alias("target")))


def call_targets(uses: DataFrame, names: DataFrame, functions: DataFrame) -> DataFrame:
    """Project function a call name means.

    ``uses(use, module, cls, call)``, ``names(module, head, meaning)``, ``functions(fn)``. Tried in order: a method of the own
    class, a name of the module, an imported name, a module imported by name, a submodule. One equality join on the
    candidates, the smallest priority wins."""
    head = F.split_part("call", F.lit("."), F.lit(1))
    u = uses.withColumn("head", head).join(names, ["module", "head"], "left")
    rest = F.when(F.contains("call", F.lit(".")), F.regexp_replace("call", r"^[^.]*\.", "")).otherwise("")
    has, tgt = F.col("rest") != "", F.col("meaning")
    named = F.coalesce(F.contains(tgt, F.lit(":")), F.lit(False))
    own = (F.col("head") == "self") & F.col("cls").isNotNull() & has & ~F.contains("rest", F.lit("."))
    t_mod, t_name = F.split_part(tgt, F.lit(":"), F.lit(1)), F.split_part(tgt, F.lit(":"), F.lit(2))
    sub, leaf = F.regexp_extract("rest", r"^(.*)\.[^.]*$", 1), F.regexp_extract("rest", r"([^.]*)$", 1)
    plain = ~own & tgt.isNotNull() & ~named & has
    u = u.withColumn("rest", rest)
    options = F.array_compact(
        F.array(
            _candidate(1, own, F.concat("module", F.lit(":"), "cls", F.lit("."), "rest")),
            _candidate(2, ~own, F.concat("module", F.lit(":"), "call")),
            _candidate(3, ~own & named, F.concat(tgt, F.when(has, F.concat(F.lit("."), "rest")).otherwise(""))),
            _candidate(4, ~own & named & has, F.concat(t_mod, F.lit("."), t_name, F.lit(":"), "rest")),
            _candidate(5, plain, F.concat(tgt, F.lit(":"), "rest")),
            _candidate(6, plain & (sub != ""), F.concat(tgt, F.lit("."), sub, F.lit(":"), leaf)),
        )
    )
    tried = u.select("use", F.explode(options).alias("o")).select("use", "o.prio", F.col("o.target").alias("fn"))
    hits = tried.join(functions.select("fn").distinct(), "fn")
    return hits.groupBy("use").agg(F.min_by("fn", "prio").alias("target"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """Modules an import may load: itself, ``module.name`` for each name, every parent package."""
    parts = F.split("target", r"\.")
    own = F.transform("names", lambda n: F.concat(F.col("target"), F.lit("."), n))
    parents = F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    ).otherwise(F.array().cast("array<string>"))
    return imports.withColumn("candidate", F.explode(F.array_union(F.array_union(F.array("target"), own), parents)))


def library_names(spark: SparkSession) -> DataFrame:
    """``top, kind``: names of the standard library and of the installed packages of this Python, ``stdlib`` or ``third_party``. As long
    as the installation."""
    installed = set(packages_distributions()) - set(sys.stdlib_module_names)
    rows = [(n, "stdlib") for n in sorted(sys.stdlib_module_names)] + [(n, "third_party") for n in sorted(installed)]
    return spark.createDataFrame(rows, "top string, kind string")


def import_classes(imports: DataFrame, project: DataFrame, libraries: DataFrame) -> DataFrame:
    """Adds ``kind`` to ``imports(run_id, target)``: ``project`` where the run has a module of the top name, else what ``libraries(top,
    kind)`` says, else ``missing``. ``project(run_id, module)``."""
    top = F.split_part("target", F.lit("."), F.lit(1))
    own = project.select("run_id", F.split_part("module", F.lit("."), F.lit(1)).alias("top"), F.lit("project").alias("__own")).distinct()
    named = imports.withColumn("top", top).join(own, ["run_id", "top"], "left")
    known = libraries.select("top", F.col("kind").alias("__kind")).dropDuplicates(["top"])
    return named.join(known, "top", "left").withColumn("kind", F.coalesce("__own", "__kind", F.lit("missing"))).drop("__own", "__kind")


def unknown_statements(explanations: DataFrame, stmts: DataFrame, hints: int = 12) -> DataFrame:
    """Explanations of statements that do not exist, with the start lines of the first ``hints`` statements of the file."""
    from .ordered import first_k

    unknown = explanations.join(stmts.select("run_id", "stmt"), ["run_id", "stmt"], "left_anti")
    near = first_k(stmts.select("run_id", "file", "ord", "line"), ["run_id", "file"], ["ord"], hints)
    near = near.groupBy("run_id", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("hint"))
    return unknown.withColumn("file", F.split_part("stmt", F.lit(":"), F.lit(1))).join(near, ["run_id", "file"], "left")


def source_priority(functions: DataFrame, depths: DataFrame, ran: DataFrame) -> DataFrame:
    """Depth of the call where it is known, 50 for a function that ran unseen, 99 for one that did not run."""
    out = functions.join(depths, ["run_id", "fn"], "left").join(ran.select("run_id", "fn", F.lit(50).alias("__ran")).distinct(), ["run_id", "fn"], "left")
    return out.withColumn("priority", F.coalesce(F.col("depth"), F.col("__ran"), F.lit(99)).cast("long")).drop("__ran", "depth")
