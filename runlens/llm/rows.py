"""Small helpers on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

ID, TIE = "__id", "__tie"


def prepared(spark: SparkSession) -> SparkSession:
    """The session's settings for rows that hold long texts: Arrow batches are bounded by rows and by bytes."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``__id`` and ``__tie``: rows that agree on both have the same id and text, so the same result."""
    return docs.withColumns({ID: F.col(key), TIE: F.xxhash64(text_of(text))})


#: bits of a sieve: 8 MB at most, however many keys there are
SIEVE = 1 << 26


def sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keyed ``rows`` whose (id, tie) may be in ``wanted``; few others stay while ``wanted`` has far fewer keys than ``SIEVE``.

    A bitmap of the hashes of the wanted keys is broadcast, at most ``SIEVE`` bits of it. It goes before a join that would
    shuffle all texts; it doesn't replace the join."""
    at = F.pmod(F.xxhash64(ID, TIE), F.lit(SIEVE))
    bits = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    place = F.bitmap_bit_position("__at").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, place % 8) == 1
    kept = rows.withColumn("__at", at).withColumn("__bucket", F.bitmap_bucket_number("__at"))
    return kept.join(F.broadcast(bits), "__bucket").where(hit).drop("__at", "__bucket", "__bits")


def give(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Left join of keyed ``docs`` to at most one row of ``found`` per (id, tie); null ids match."""
    found = found.withColumnsRenamed({ID: "__fid", TIE: "__ftie"})
    on = F.col(ID).eqNullSafe(F.col("__fid")) & (F.col(TIE) == F.col("__ftie"))
    return docs.join(found, on, "left").drop("__fid", "__ftie")
