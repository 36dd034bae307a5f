"""Chains of declared steps, and what each step of a chain did to the rows.

A step says which columns it changes, which rows it keeps, or by which keys it keeps the first row. Being data, a chain can be
run (``apply_steps``) or followed: ``follow`` compiles all of it into one plan that counts the rows behind every step in
one pass over the input. Steps that are plain functions can be timed one after another (``staged_ledger``)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import first_k


@dataclass(frozen=True)
class Step:
    """One of ``columns`` (name -> new value), ``keep`` (rows that stay) or ``first`` (keys, order). Columns are made when the
    step is used, so steps can be declared without a session."""

    name: str
    columns: Callable[[], dict[str, Column]] | None = None
    keep: Callable[[], Column] | None = None
    first: tuple[list[str], list[str]] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.columns:
            df = df.withColumns(self.columns())
        if self.keep:
            df = df.filter(self.keep())
        return first_k(df, *self.first, 1) if self.first else df


def apply_steps(df: DataFrame, steps) -> DataFrame:
    return reduce(lambda acc, step: acc.transform(step), steps, df)


def follow(df: DataFrame, steps: list[Step]) -> DataFrame:
    """One row ``n0 ... nk``: rows of the input and behind each step, by one scan.

    A row that a step drops stays as a dead row with its counts. Where the first row of each key is kept, a key becomes one
    row with the sums of its counts, and all dead rows become one; that is a partial aggregate, so neither a hot key nor
    the dead rows are shuffled one by one. Changed columns are computed for living rows only."""
    alive, counts = "__alive", ["__n0"]
    state = df.withColumns({alive: F.lit(True), "__n0": F.lit(1).cast("long")})
    for i, step in enumerate(steps, 1):
        if step.columns:
            state = state.withColumns({name: F.when(F.col(alive), value) for name, value in step.columns().items()})
        if step.keep:
            state = state.withColumn(alive, F.col(alive) & F.coalesce(step.keep(), F.lit(False)))
        if step.first:
            keys, order = step.first
            rest = [c for c in state.columns if c not in {alive, *keys, *counts}]
            living = [F.when(F.col(alive), F.col(k)).alias(k) for k in keys]
            at = F.when(F.col(alive), F.struct(*order))
            state = state.groupBy(alive, *living).agg(
                F.min_by(F.struct(*rest), at).alias("__row"), *[F.sum(c).alias(c) for c in counts]
            )
            state = state.select(alive, *keys, "__row.*", *counts)
        counts.append(f"__n{i}")
        state = state.withColumn(counts[-1], F.col(alive).cast("long"))
    return state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c[2:]) for c in counts])


LEDGER = "seq long, step string, rows_in long, rows_out long, delta long, cols_delta long"


def ledger(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Rows into and out of each declared step, columns won or lost, and ``pass_ms``, the time of the one pass over the input
    that all steps share (steps that run fused have no times of their own).

    The counts are aggregates of the plan: metrics collected on the side would count a task twice when an executor is
    lost. The pass runs here; the ledger has a row per step."""
    cols, shape = [len(df.columns)], df.limit(0)
    for step in steps:
        shape = step(shape)
        cols.append(len(shape.columns))
    start = time.perf_counter()
    n = follow(df, steps).first()
    ms = (time.perf_counter() - start) * 1000
    rows = [
        (i, step.name, n[i - 1], n[i], n[i] - n[i - 1], cols[i] - cols[i - 1], ms) for i, step in enumerate(steps, 1)
    ]
    return df.sparkSession.createDataFrame(rows, LEDGER + ", pass_ms double")


def staged_ledger(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The result of any chain of ``df -> df`` functions, and its ledger with the time ``ms`` of each step.

    Each step reads what the one before wrote, so the input is read once and a step's time is its own. Rows are counted
    from the footers of the written files."""
    rows, before, n = [], df, None
    for i, step in enumerate(steps, 1):
        start = time.perf_counter()
        name = step.name if isinstance(step, Step) else getattr(step, "__name__", str(step))
        if n is None:
            before = materialise(before, "input")
            n, start = before.count(), time.perf_counter()
        after = materialise(step(before), name)
        out = after.count()
        ms = (time.perf_counter() - start) * 1000
        rows.append((i, name, n, out, out - n, len(after.columns) - len(before.columns), ms))
        before, n = after, out
    return before, df.sparkSession.createDataFrame(rows, LEDGER + ", ms double")
