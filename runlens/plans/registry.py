"""Registered queries: a name, a DataFrame builder and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import materialise, tune

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one directory, each read lazily as ``t.<name>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = tune(spark)
        self.path = path
        self._stages: dict[str, DataFrame] = {}

    def file(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage that one query uses several times: written once, read as often as needed."""
        if name not in self._stages:
            self._stages[name] = materialise(build(), name)
        return self._stages[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.file(name))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
