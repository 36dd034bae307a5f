"""Where users plug in their own functions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_row(fn: Callable, returns: str) -> Callable[..., Column]:
    """A plain Python function of one record as a column function, applied to batches of rows. The escape hatch: write
    column expressions where they can say it."""

    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*cols)])

    return run


def counted(df: DataFrame, fn: Callable[[dict], Iterator[tuple[str, str]]], columns: list[str]) -> DataFrame:
    """User aggregate with counters: ``fn`` turns a record into (counter, key) pairs.

    Pairs are counted in each batch of rows first; only the counts are shuffled and summed."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            for record in pdf.to_dict("records"):
                n.update(fn(record))
            yield pd.DataFrame([(c, k, v) for (c, k), v in n.items()], columns=["counter", "key", "n"])

    parts = df.select(*columns).mapInPandas(partial, "counter string, key string, n long")
    return parts.groupBy("counter", "key").agg(F.sum("n").alias("n"))


def table_function(df: DataFrame, fn: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """User table function: each record gives no, one or several records."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for record in pdf.to_dict("records") for r in fn(record)], columns=names)

    return df.mapInPandas(run, schema)
