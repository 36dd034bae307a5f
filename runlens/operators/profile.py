"""What a dataset looks like, never the data itself: profiles, masks, ledgers, schema changes, fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MASK, cell, is_secret_name, masked, redact, short

# How much of a value is shown.
NAMES, SHOWN_COLUMNS, SHOWN_ROWS, SERIES, ITEMS, KEYS, VALUES, FIELDS = 40, 10, 3, 5, 3, 25, 6, 12


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Single-row tables side by side, by a union and one aggregate."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def schema_profile(df: DataFrame) -> DataFrame:
    """Names and types only: no row is read, so it also fits a lazy or streaming table."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields[:NAMES])]
    return df.sparkSession.createDataFrame(rows, "name string, dtype string, pos int")


@contextmanager
def footers_only(spark: SparkSession) -> Iterator[None]:
    """Counts are pushed into Parquet scans, which answer them from the footers of the files and read no page. That needs the
    reader's second interface. The settings are put back."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: number of rows, and of values that are not null in each plain column."""
    table = spark.read.parquet(path)
    plain = [f.name for f in table.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return table.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in plain])


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """``name, rows, filled`` of the plain columns of a Parquet table, from the footers of its files. The result has a row per
    column, so it is made here."""
    with footers_only(spark):
        found = counts(spark, path).first().asDict()
    rows = found.pop("__rows")
    return spark.createDataFrame([(c, rows, n) for c, n in found.items()], "name string, rows long, filled long")


def table_profile(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows, columns, first names and types, and the first three rows in ``order`` as short redacted cells."""
    shown = df.columns[:SHOWN_COLUMNS]
    head = df.orderBy(*order).limit(SHOWN_ROWS)
    cells = F.struct(*order, F.array(*[cell(F.col(c)) for c in shown]).alias("__cells"))
    sample = head.agg(F.transform(F.array_sort(F.collect_list(cells)), lambda x: x["__cells"]).alias("sample_rows"))
    fields = df.schema.fields[:NAMES]
    total = df.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {
            "cols": F.lit(len(df.columns)).cast("long"),
            "columns": F.array(*[F.lit(f.name) for f in fields]),
            "dtypes": F.array(*[F.lit(f.dataType.simpleString()) for f in fields]),
        }
    )
    return one_row([total, sample])


def column_profile(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    head = df.select(*order, column).orderBy(*order).limit(SERIES)
    sample = head.agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*order, cell(F.col(column)).alias("__c")))), lambda x: x["__c"]).alias("sample")
    )
    total = df.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"name": F.lit(column), "dtype": F.lit(df.schema[column].dataType.simpleString())}
    )
    return one_row([total, sample])


def array_summary(c: Column) -> Column:
    return F.struct(F.size(c).cast("long").alias("len"), F.transform(F.slice(c, 1, ITEMS), lambda x: cell(x)).alias("sample"))


def map_summary(c: Column) -> Column:
    keys = F.map_keys(c)
    first = F.slice(keys, 1, VALUES)
    values = F.transform(first, lambda k: F.when(is_secret_name(k), F.lit(MASK)).otherwise(cell(F.element_at(c, k), 60)))
    return F.struct(
        F.size(keys).cast("long").alias("len"),
        F.transform(F.slice(keys, 1, KEYS), lambda k: cell(k, 40)).alias("keys"),
        values.alias("values"),
    )


def struct_summary(c: Column, fields: list[str]) -> Column:
    names = F.array(*[F.lit(f) for f in fields[:FIELDS]])
    values = [F.when(is_secret_name(F.lit(f)), F.lit(MASK)).otherwise(cell(c[f], 60)) for f in fields[:VALUES]]
    return F.struct(names.alias("fields"), F.array(*values).alias("values"))


def string_summary(c: Column) -> Column:
    return F.struct(F.length(c).cast("long").alias("len"), short(redact(c), 100).alias("value"))


def binary_summary(c: Column) -> Column:
    return F.struct(F.octet_length(c).cast("long").alias("len"))


def http_summary(status: Column, content_type: Column, url: Column) -> Column:
    return F.struct(status.alias("status"), content_type.alias("content_type"), redact(short(url, 140)).alias("url"))


# how a value of a type is summarised; users may add to it
SUMMARIES = {
    T.StringType: string_summary,
    T.BinaryType: binary_summary,
    T.ArrayType: array_summary,
    T.MapType: map_summary,
}


def summarise_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by the summary of its type as JSON; plain values as short text; secret names masked."""
    out = []
    for name in columns:
        f = df.schema[name]
        if isinstance(f.dataType, T.StructType):
            s = F.to_json(struct_summary(F.col(name), f.dataType.names))
        elif type(f.dataType) in SUMMARIES:
            s = F.to_json(SUMMARIES[type(f.dataType)](F.col(name)))
        else:
            s = cell(F.col(name), 60)
        out.append(F.when(is_secret_name(F.lit(name)), F.lit(MASK)).otherwise(s).alias(name))
    return df.select(*out)


def mask(df: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """Secret-named columns become ``***``, every other text is redacted. ``allow`` names columns to leave alone."""
    out = []
    for f in df.schema.fields:
        if f.name not in allow and isinstance(f.dataType, T.StringType):
            out.append(masked(f.name, F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def filled(df: DataFrame) -> DataFrame:
    """Name, type and number of values that are not null, per column, in one pass."""
    one = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    items = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f.name).alias("filled")) for f in df.schema.fields]
    )
    return one.select(F.explode(items).alias("x")).select("x.*")


def schema_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed, retyped or kept between two stages, with their filled values."""
    a = filled(before).select("name", F.col("dtype").alias("type_before"), F.col("filled").alias("filled_before"))
    b = filled(after).select("name", F.col("dtype").alias("type_after"), F.col("filled").alias("filled_after"))
    change = (
        F.when(F.col("type_before").isNull(), "added").when(F.col("type_after").isNull(), "removed")
        .when(F.col("type_before") != F.col("type_after"), "retyped").otherwise("kept")
    )
    return a.join(b, "name", "full").withColumn("change", change)


def fingerprint(df: DataFrame) -> DataFrame:
    """Number of rows and two sums over row hashes: equal for equal content, whatever the order of the rows."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("mix"), F.sum(h.cast("decimal(38,0)")).alias("sum"))


def job_summary(stages: DataFrame, io: DataFrame) -> DataFrame:
    """Headline numbers: rows into the first stage, rows out of the last one, side effects held and real."""
    from .effects import is_intercepted, is_real_effect

    a = stages.agg(F.min_by("rows_in", "seq").alias("rows_in"), F.max_by("rows_out", "seq").alias("rows_out"), F.count(F.lit(1)).alias("stages"))
    b = io.agg(F.count_if(is_intercepted()).alias("held"), F.count_if(is_real_effect()).alias("real"))
    return one_row([a, b])
