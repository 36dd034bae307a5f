"""Reports, tables and outboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import scan


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, src: str, dst: str) -> None:
    fs, a = _fs(spark, src)
    _, b = _fs(spark, dst)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"could not move {src} to {dst}")


def write_report(df: DataFrame, out: str, run_date: str) -> str:
    """CSV report of a run date, with header; the folder is made if it is missing."""
    path = f"{out}/run_date={run_date}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_table(df: DataFrame, target: str, full_refresh: bool = False) -> int:
    """Append to a table, or replace it, in one pass; returns the number of rows saved, counted by the tasks that wrote them.

    A replacement is written beside the table first. When it is whole, the old table is moved aside, the new one into
    place, and only then the old one goes. A job that fails in between leaves one of them; the next call puts an old
    table back that has no successor."""
    spark, target = df.sparkSession, target.rstrip("/")
    fresh, aside = f"{target}__new", f"{target}__old"
    if exists(spark, aside) and not exists(spark, target):
        move(spark, aside, target)
    # counted in the writing stage itself, where a task that runs again counts once
    saved = Observation()
    counted = df.observe(saved, F.count(F.lit(1)).alias("rows"))
    if not full_refresh:
        counted.write.mode("append").parquet(target)
        return saved.get["rows"]
    counted.write.mode("overwrite").parquet(fresh)
    if exists(spark, target):
        delete(spark, aside)
        move(spark, target, aside)
    move(spark, fresh, target)
    delete(spark, aside)
    return saved.get["rows"]


def write_json(df: DataFrame, path: str) -> str:
    """JSON records, one per line, in as many files as there are tasks."""
    df.write.json(path)
    return path


def alert_pages(rows: DataFrame, pos: str, columns: list[str], page: int = 1000) -> DataFrame:
    """Alert payload ``{count, stations}``. The list is cut into pages, each with the total count, so an alert of any size
    never has to fit into one row."""
    numbered = scan(rows, [], pos, row_number="__n", ranges=True)
    paged = numbered.withColumn("page", F.floor((F.col("__n") - 1) / page).cast("long"))
    pages = paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("__n", *columns))).alias("x"))
    items = F.transform("x", lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    total = rows.agg(F.count(F.lit(1)).alias("count")).scalar()
    return pages.select("page", F.to_json(F.struct(total.alias("count"), items.alias("stations"))).alias("payload"))
