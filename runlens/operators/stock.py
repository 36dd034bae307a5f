"""The stock job: what to reorder, and how much, per supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import reorder_quantity
from .ordered import scan

PAGE = 1000


def order_lines(items: DataFrame) -> DataFrame:
    return items.withColumn("qty", reorder_quantity(F.col("on_hand"), F.col("daily_sales"))).filter(F.col("qty") != 0)


def order_pages(lines: DataFrame, pos: str = "sku", page: int = PAGE) -> DataFrame:
    """The order of each supplier, in item order, in pages of ``page`` lines: a supplier of any size never
    has to fit into one row."""
    numbered = scan(lines, ["supplier"], pos, row_number="__line")
    return (
        numbered.withColumn("page", F.floor((F.col("__line") - 1) / page).cast("long"))
        .groupBy("supplier", "page")
        .agg(F.array_sort(F.collect_list(F.struct("__line", "sku", "qty"))).alias("x"))
        .select("supplier", "page", F.transform("x", lambda r: F.struct(r["sku"].alias("sku"), r["qty"].alias("qty"))).alias("lines"))
    )


def order_totals(lines: DataFrame) -> DataFrame:
    per = lines.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        F.count(F.lit(1)).alias("suppliers"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("units"),
    )
