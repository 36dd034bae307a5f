"""Rounding and rates. Everything rounds half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scale of sums over measured doubles: a decimal sum does not depend on the order of the rows
EXACT = "decimal(28,8)"


def half_even(x: Column, digits: int = 0) -> Column:
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def exact_sum(x: Column) -> Column:
    return F.sum(x.cast(EXACT))


def exact_mean(x: Column) -> Column:
    return exact_sum(x).cast("double") / F.count(x)


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def to_celsius(temp: Column, unit: Column) -> Column:
    return F.when(unit == "F", (temp - 32) * 5 / 9).otherwise(temp)


def reorder_quantity(on_hand: Column, daily: Column, cover_days: int = 7, minimum: int = 10) -> Column:
    """Units to order so that ``cover_days`` of sales are on hand: 0 when nothing is short, else at least
    ``minimum``."""
    shortfall = daily * cover_days - on_hand
    return F.when(shortfall > 0, F.greatest(F.lit(float(minimum)), F.rint(shortfall))).otherwise(0.0).cast("long")
