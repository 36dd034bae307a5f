"""Ordered scans (row number, neighbour, running total, last value) that survive a hot key.

``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to one task. Here the rows of a key are
cut into spans of ``seq`` first. Each (key, span) is scanned on its own, one small row per span is carried
across the spans of the key, and the two are joined. There is one plan for every size. Where ``seq`` is a whole number
that is unique within the key, a span never holds more than ``span`` rows, however many rows the key has; where it is a
time, a span holds what happened in ``span`` units. The carry of a key sorts its spans, one small row each.

Where no column says how dense a key is (ranks over everything, orders by text), spans are the ranges of a range partition
instead (``ranges``): as even as the sample of the partitioner, and as many as there are partitions, not rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, written

SPAN = 1 << 12
_CHUNK = "__span"
_AT = "__key_span"


def _key_span(keys: list[str]) -> Column:
    """A key and its span as one value that is never null and equal where all parts are equal or null. Windows inside a span
    and the join with what is carried into it use it alike, so the rows are shuffled and sorted once for both."""
    return F.struct(*keys, _CHUNK)


def scan(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    *,
    row_number: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    total: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    span: float = SPAN,
    settled: bool = False,
    ranges: bool = False,
) -> DataFrame:
    """Add ordered columns to ``df``.

    ``order`` must be unique within the key; spans are cut from its first column, a number (or a time,
    counted in seconds), ``span`` units wide. ``row_number``: name of the 1-based position within the key.
    ``lag`` / ``lead``: new name -> column, value in the previous / next row. ``total``: new name -> column,
    running sum up to this row. ``last``: new name -> column, latest value that is not null, this row included.

    ``ranges``: spans are ranges of all of ``keys`` and ``order``, which may then be of any type; without ``keys`` the whole
    table is one sequence.

    The input is read twice. It is written to the shared folder first unless ``settled`` says that it is cheap to
    read again (a table scan with projections and filters), so chained scans do not multiply their inputs.
    """
    lag, lead, total, last = lag or {}, lead or {}, total or {}, last or {}
    order = [order] if isinstance(order, str) else order
    if ranges:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(parts, *keys, *order).withColumn(_CHUNK, F.spark_partition_id().cast("long"))
        base = materialise(dealt, "ranges")
    else:
        df = df if settled else written(df)
        first = F.col(order[0])
        if dict(df.dtypes)[order[0]].startswith("timestamp"):
            first = F.unix_micros(first.cast("timestamp")) / 1000000
        base = df.withColumn(_CHUNK, F.floor(first / F.lit(span)).cast("long"))
    at = F.struct(*order)

    # one row per (key, span)
    aggs = []
    if row_number:
        aggs.append(F.count(F.lit(1)).alias("__n"))
    if lag:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(lag.values())]), at).alias("__lag"))
    if lead:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(lead.values())]), at).alias("__lead"))
    for i, col in enumerate(total.values()):
        aggs.append(F.sum(col).alias(f"__sum{i}"))
    for i, col in enumerate(last.values()):
        aggs.append(F.max_by(F.col(col), F.when(F.col(col).isNotNull(), at)).alias(f"__last{i}"))
    spans = base.groupBy(*keys, _CHUNK).agg(*aggs)

    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [_key_span(keys).alias("__into")]
    if row_number:
        carried.append(F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    if lag:
        carried.append(F.lag("__lag").over(across).alias("__lag"))
    if lead:
        carried.append(F.lead("__lead").over(across).alias("__lead"))
    for i in range(len(total)):
        zero = F.lit(0).cast(spans.schema[f"__sum{i}"].dataType)
        carried.append(F.coalesce(F.sum(f"__sum{i}").over(earlier), zero).alias(f"__sum{i}"))
    carried += [F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__last{i}") for i in range(len(last))]
    carry = spans.select(*carried)

    # inside each span
    inside = Window.partitionBy(_AT).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols: dict[str, Column] = {}
    if row_number:
        cols["__rn"] = F.row_number().over(inside).cast("long")
    if lag:
        cols["__plag"] = F.lag(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(lag.values())])).over(inside)
    if lead:
        cols["__plead"] = F.lead(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(lead.values())])).over(inside)
    for i, col in enumerate(total.values()):
        cols[f"__psum{i}"] = F.sum(col).over(upto)
    for i, col in enumerate(last.values()):
        cols[f"__plast{i}"] = F.last(col, ignorenulls=True).over(upto)
    local = base.withColumn(_AT, _key_span(keys)).withColumns(cols)

    both = local.join(carry, F.col(_AT) == F.col("__into"), "inner")

    out = [F.col(c) for c in df.columns]
    if row_number:
        out.append((F.col("__rn") + F.col("__n")).alias(row_number))
    for i, name in enumerate(lag):
        out.append(F.when(F.col("__plag").isNull(), F.col(f"__lag.v{i}")).otherwise(F.col(f"__plag.v{i}")).alias(name))
    for i, name in enumerate(lead):
        out.append(F.when(F.col("__plead").isNull(), F.col(f"__lead.v{i}")).otherwise(F.col(f"__plead.v{i}")).alias(name))
    for i, name in enumerate(total):
        out.append((F.coalesce(F.col(f"__psum{i}"), F.lit(0)) + F.col(f"__sum{i}")).alias(name))
    for i, name in enumerate(last):
        out.append(F.coalesce(F.col(f"__plast{i}"), F.col(f"__last{i}")).alias(name))
    return both.select(*out)


def first_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key. The limit is applied on the map side (WindowGroupLimit), so at most
    ``k`` rows per key and task are shuffled; a ``k`` beyond what the session limits that way is refused."""
    most = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > most:
        raise ValueError(f"first {k} rows of a key: more than spark.sql.optimizer.windowGroupLimitThreshold = {most}")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") <= k)
    return out.withColumnRenamed("__rk", rank) if rank else out.drop("__rk")


def capped(tables: dict[str, tuple[DataFrame, list, int]], keys: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The first rows of each key in several tables, and which keys had more.

    ``tables``: name -> (table, order, most rows of a key). Returns the cut tables by name, and a row per key that any
    table has: ``truncated`` and ``over``, the names of the tables that were cut, in their order here. Caps apply on the map
    side, and what was there is counted by a partial aggregate, so no key is ever gathered."""
    cut_tables = {name: first_k(df, keys, order, most) for name, (df, order, most) in tables.items()}
    counts = [
        df.groupBy(*keys).agg((F.count(F.lit(1)) > most).alias("cut")).select(*keys, F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), "cut").alias("t"))
        for i, (name, (df, _, most)) in enumerate(tables.items())
    ]
    per = reduce(DataFrame.unionByName, counts).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))  # a row per table
    over = F.transform(F.filter("ts", lambda x: x["cut"]), lambda x: x["name"])
    return cut_tables, per.select(*keys, (F.size(over) > 0).alias("truncated"), over.alias("over"))


def islands(
    df: DataFrame,
    keys: list[str],
    order: str | list[str],
    same_as: list[str],
    out: str,
    span: float = SPAN,
    breaks: Column | None = None,
    settled: bool = False,
) -> DataFrame:
    """Number the runs of neighbouring rows that agree on ``same_as`` (gaps and islands). A true ``breaks``
    starts a new run anyway. Numbers start at 1 in each key. Spans are numbered on their own; per span only the
    first and last row and the number of runs are carried on."""
    order = [order] if isinstance(order, str) else order
    df = df if settled else written(df)
    forced = F.lit(False) if breaks is None else F.coalesce(breaks, F.lit(False))
    base = df.withColumns(
        {_CHUNK: F.floor(F.col(order[0]) / F.lit(span)).cast("long"), "__tag": F.struct(*same_as), "__forced": forced}
    )
    inside = Window.partitionBy(_AT).orderBy(*order)
    local = base.withColumn(_AT, _key_span(keys)).withColumn("__prev", F.lag("__tag").over(inside))
    new = F.col("__prev").isNotNull() & (F.col("__forced") | ~F.col("__tag").eqNullSafe(F.col("__prev")))
    local = local.withColumn("__new", new.cast("long"))
    local = local.withColumn("__upto", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.struct(*order)
    spans = local.groupBy(_AT).agg(
        F.min_by(F.struct("__tag", "__forced"), at).alias("__first"),
        F.max_by("__tag", at).alias("__last"),
        F.sum("__new").alias("__runs"),
    ).select(f"{_AT}.*", "__first", "__last", "__runs")
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = F.lag("__last").over(across)
    edge = (before.isNull() | F.col("__first.__forced") | ~before.eqNullSafe(F.col("__first.__tag"))).cast("long")
    spans = spans.withColumn("__edge", edge)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("__runs") + F.col("__edge")).over(earlier), F.lit(0).cast("long")) + F.col("__edge")
    carry = spans.select(_key_span(keys).alias("__into"), start.alias("__start"))
    return local.join(carry, F.col(_AT) == F.col("__into")).select(*[F.col(c) for c in df.columns], (F.col("__upto") + F.col("__start")).alias(out))


def value_before_run(
    df: DataFrame, keys: list[str], order: str | list[str], col: str, out: str, span: float = SPAN, settled: bool = False
) -> DataFrame:
    """The value of ``col`` that preceded the current run of equal values; null in the first run of a key.

    Inside a span it is the value before the latest change. A span without a change takes over what the spans before
    it ended with."""
    order = [order] if isinstance(order, str) else order
    df = df if settled else written(df)
    base = df.withColumn(_CHUNK, F.floor(F.col(order[0]) / F.lit(span)).cast("long"))
    inside = Window.partitionBy(_AT).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumn(_AT, _key_span(keys)).withColumn("__prev", F.lag(col).over(inside))
    local = local.withColumn("__changed", F.when(F.col("__prev") != F.col(col), F.col("__prev")))
    local = local.withColumn("__local", F.last("__changed", ignorenulls=True).over(upto))
    at = F.struct(*order)
    spans = local.groupBy(_AT).agg(
        F.min_by(col, at).alias("__first"), F.max_by(col, at).alias("__end"), F.max_by("__local", at).alias("__before")
    ).select(f"{_AT}.*", "__first", "__end", "__before")
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    was = F.lag("__end").over(across)
    spans = spans.withColumn("__edge", F.when(was != F.col("__first"), was))
    handed = F.last(F.coalesce("__before", "__edge"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carry = spans.select(_key_span(keys).alias("__into"), F.coalesce(F.col("__edge"), handed).alias("__start"))
    return local.join(carry, F.col(_AT) == F.col("__into")).select(*[F.col(c) for c in df.columns], F.coalesce("__local", "__start").alias(out))
