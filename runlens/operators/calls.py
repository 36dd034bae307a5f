"""Aggregates over recorded calls, line events, imports and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_sum, half_even
from .ordered import first_k
from .trees import fold_up

DETAIL = 3


def function_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and total time per function. Times include the calls below, so totals may exceed the run."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), half_even(exact_sum(F.col("dur_ms")).cast("double"), 2).alias("total_ms")
    )


def detailed_calls(calls: DataFrame, k: int = DETAIL) -> DataFrame:
    """Calls kept in detail: the first ``k`` of a function under one call that is itself kept in detail."""
    first = first_k(calls, ["run_id", "parent", "fn"], ["node"], k)
    # kept if the chain of first calls ends at a root, and not at a call that is missing
    rooted = fold_up(first, ["run_id"], "node", "parent", {"rooted": F.col("parent").isNull()}, lambda below, above: above)
    return first.join(rooted.filter("rooted").select("run_id", "node"), ["run_id", "node"], "left_semi")


def repeats(calls: DataFrame, kept: DataFrame, k: int = DETAIL) -> DataFrame:
    """Calls per kept parent and function beyond the detailed ones. Calls below a collapsed call count nowhere here."""
    per = calls.filter(F.col("parent").isNotNull()).groupBy("run_id", "parent", "fn").agg(F.count(F.lit(1)).alias("n"))
    up = kept.select("run_id", F.col("node").alias("parent"))
    return per.filter(F.col("n") > k).join(up, ["run_id", "parent"], "left_semi").select(
        "run_id", "parent", "fn", (F.col("n") - k).alias("repeats")
    )


def coverage(lines: DataFrame, cap: int, k: int = DETAIL) -> DataFrame:
    """Events recorded in detail (first ``k`` of each line in each call, at most ``cap`` per run) and only counted."""
    per = lines.groupBy("run_id", "node", "line").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("run_id").agg(F.sum(F.least(F.col("n"), F.lit(k))).alias("detail"), F.sum("n").alias("events"))
    recorded = F.least(F.col("detail"), F.lit(cap))
    return total.select(
        "run_id", recorded.cast("long").alias("recorded"), (F.col("events") - recorded).cast("long").alias("counted_only"),
        (F.col("detail") > cap).alias("truncated"),
    )


def libraries(imports: DataFrame) -> DataFrame:
    """External libraries by top package with the modules that use them, in order of first use. The list holds distinct
    modules: it is as long as the code has files."""
    out = imports.filter(F.col("kind") != "project").withColumn("name", F.split_part("target", F.lit("."), F.lit(1)))
    per = out.groupBy("run_id", "name", "module").agg(F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"))
    return per.groupBy("run_id", "name").agg(
        F.min_by("kind", "pos").alias("kind"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "module"))), lambda x: x["module"]).alias("used_by"),
    )


def executed(functions: DataFrame, stats: DataFrame) -> DataFrame:
    """Defined functions with their run-time numbers; null numbers mean that the function did not run."""
    return functions.join(stats, ["run_id", "fn"], "left").withColumn("executed", F.col("calls").isNotNull())


def never_ran(functions: DataFrame, calls: DataFrame, name: str = "name") -> DataFrame:
    return functions.filter(~F.col(name).startswith("__")).join(calls, ["run_id", "fn"], "left_anti")


def prefer_first(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by key; where several sources have a key, the first source wins."""
    tagged = [df.withColumn("__src", F.lit(i)) for i, df in enumerate(sources)]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df)
    cols = [c for c in sources[0].columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*cols), "__src").alias("__s")).select(*keys, "__s.*")


def resolve(candidates: DataFrame, keys: list[str], value: str, prio: str = "prio") -> DataFrame:
    """The candidate with the smallest priority number per key."""
    return candidates.groupBy(*keys).agg(F.min_by(value, prio).alias(value))
