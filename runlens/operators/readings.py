"""The readings job: clean, enrich, summarise per day, flag days far from their region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_mean, half_even, to_celsius
from .chain import Step, apply_steps


@dataclass(frozen=True)
class ReadingSettings:
    low: float = -40.0
    high: float = 55.0
    z: float = 1.4


celsius = Step("celsius", columns=lambda: {"temp": to_celsius(F.col("temp"), F.col("unit")), "unit": F.lit("C")})
drop_missing = Step("drop_missing", keep=lambda: F.col("temp").isNotNull() & ~F.isnan("temp") & F.col("station_id").isNotNull())
# a reading that was sent again is dropped; the first in input order stays
first_per_time = Step("first_per_time", first=(["station_id", "timestamp"], ["pos"]))


def in_range(low: float, high: float) -> Step:
    return Step("in_range", keep=lambda: F.col("temp").between(low, high))


def cleaning_steps(s: ReadingSettings) -> list[Step]:
    return [celsius, drop_missing, in_range(s.low, s.high), first_per_time]


def enrich(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Every reading kept. No broadcast hint: the engine measures the stations and splits hot ones."""
    return df.join(stations, "station_id", "left")


def daily_summary(df: DataFrame) -> DataFrame:
    """Min, max, mean, count per station and day. Rows without a key are dropped."""
    keys = ["station_id", "name", "region", "day"]
    return (
        df.withColumn("day", F.to_date("timestamp"))
        .na.drop(subset=keys)
        .groupBy(*keys)
        .agg(
            F.min("temp").alias("min"),
            F.max("temp").alias("max"),
            half_even(exact_mean(F.col("temp")), 2).alias("mean"),
            F.count("temp").alias("count"),
        )
    )


def with_z(summary: DataFrame, group: str = "region", value: str = "mean") -> DataFrame:
    """Distance from the mean of the group in sample deviations; null in a group without spread.

    Group statistics and a join instead of a window: partial sums leave each task, never a whole group."""
    stats = summary.groupBy(group).agg(F.avg(value).alias("__avg"), F.stddev_samp(value).alias("__std"))
    z: Column = (F.col(value) - F.col("__avg")) / F.nullif(F.col("__std"), F.lit(0.0))
    return summary.join(stats, group, "left").withColumn("z", z).drop("__avg", "__std")


def anomalies(summary: DataFrame, s: ReadingSettings) -> DataFrame:
    return with_z(summary).filter(F.abs("z") > s.z)


def flagged_days(readings: DataFrame, stations: DataFrame, s: ReadingSettings) -> DataFrame:
    return anomalies(daily_summary(enrich(apply_steps(readings, cleaning_steps(s)), stations)), s)
