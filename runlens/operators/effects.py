"""Reads and writes of a run: which were held back, which were real, coalesced counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
HELD = ["redirected", "blocked", "shadowed", "working-copy"]


def _handled() -> Column:
    # a missing mark means that the effect was real
    return F.coalesce(F.col("handled"), F.lit(""))


# Operations that never hold back, and that never change, anything
NO_EFFECT_HELD, NO_REAL_EFFECT = ["read", "connect", "mkdir"], ["read", "connect", "read-after-write"]


def is_intercepted() -> Column:
    return _handled().isin(HELD) & ~F.col("op").isin(NO_EFFECT_HELD)


def is_real_effect() -> Column:
    return ~_handled().isin(HELD + ["read-redirected"]) & ~F.col("op").isin(NO_REAL_EFFECT)


def failed_in(frames: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Only frames of the project count; the last one is where the run failed."""
    own = frames.filter("is_project")
    return own.groupBy(*keys).agg(F.max_by("fn", pos).alias("failed_in"), F.count(F.lit(1)).alias("frames"))


def coalesce_io(io: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Equal reads and writes as one row. The first one gives place, call and time; rows and bytes add up and
    stay missing where none was measured."""
    keys = keys or ["run_id", "kind", "op", "target", "fn", "handled"]
    first = F.min_by(F.struct("node", "t_ms"), F.col("seq"))
    return (
        io.groupBy(*keys)
        .agg(
            F.min("seq").alias("seq"),
            first.alias("f"),
            F.count(F.lit(1)).alias("count"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_bytes").alias("n_bytes"),
        )
        .select(*keys, "seq", "f.node", "f.t_ms", "count", "n_rows", "n_bytes")
    )


def shadow_rows(writes: DataFrame) -> DataFrame:
    """Rows held back per table, and the file that holds them."""
    return writes.groupBy("run_id", "tbl").agg(F.sum("n_rows").alias("n_rows"), F.min_by("file", "seq").alias("file"))


def last_state(df: DataFrame, keys: list[str], seq: str, cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("s")).select(*keys, "s.*")
