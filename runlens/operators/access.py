"""The access-log job: parse lines, error rate per endpoint, alert when the total rate is too high."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even, rate
from ..functions.text import endpoint, is_log_line, log_fields, percent
from .profile import one_row

# Fixed value: the rate above which there is an alert
ALERT_RATE = 0.05


def parse(lines: DataFrame) -> DataFrame:
    """Lines that are not requests are dropped; see ``rejected`` for their number."""
    return lines.filter(is_log_line(F.col("value"))).select("line_no", *[c.alias(n) for n, c in log_fields(F.col("value")).items()])


def rejected(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count_if(is_log_line(F.col("value"))).alias("parsed"),
        F.count_if(~is_log_line(F.col("value"))).alias("rejected"),
    )


def endpoint_rates(requests: DataFrame) -> DataFrame:
    return (
        requests.groupBy(endpoint(F.col("path")).alias("endpoint"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("status") >= 500).alias("errors"),
            F.min("line_no").alias("first_line"),
        )
        .withColumn("error_rate", half_even(F.col("errors") / F.col("requests"), 4))
    )


def by_requests(rates: DataFrame) -> DataFrame:
    """Most requests first, ties by first appearance."""
    return rates.orderBy(F.desc("requests"), "first_line")


def total_rate(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
    ).withColumn("rate", rate(F.col("errors"), F.col("requests")))


def decision(rates: DataFrame, threshold: float = ALERT_RATE) -> DataFrame:
    return total_rate(rates).withColumn("taken", F.col("rate") > threshold)


def worst(rates: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` endpoints with most errors; ties keep the order by requests."""
    return rates.orderBy(F.desc("errors"), F.desc("requests"), "first_line").limit(k)


def alert(rates: DataFrame, threshold: float = ALERT_RATE, k: int = 5) -> DataFrame:
    """One outbox row when the rate is above the threshold, none otherwise. The body holds ``k`` lines."""
    lines = worst(rates, k).agg(
        F.array_sort(
            F.collect_list(F.struct(-F.col("errors"), -F.col("requests"), F.col("first_line"), "endpoint", "errors"))
        ).alias("w")
    )
    body = F.array_join(F.transform("w", lambda x: F.concat(x["endpoint"], F.lit(": "), x["errors"], F.lit(" errors"))), "\n")
    both = one_row([decision(rates, threshold), lines])
    # The words of the subject and of the body
    return both.filter("taken").select(
        F.concat(F.lit("Error rate "), percent(F.col("rate")), F.lit(" in last night's traffic")).alias("subject"),
        body.alias("body"),
    )
