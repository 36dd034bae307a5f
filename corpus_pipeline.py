"""A training corpus from ``documents``: five stages, each a table that the next one reads.

quality rules -> line dedup -> MinHash near-dedup -> substring dedup -> packing. All stages but the last return the
columns of ``documents``; texts that a stage changes keep their id, ``n_chars`` stays that of the source. Each stage
handles null ids and texts and empty tables as its operator says. Extra columns keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import lineruns, neardup, packing, quality_rules, substring
from runlens.llm.rows import prepared
from runlens.session import materialise


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on documents whose other columns have names that no operator uses; the result has the columns of ``docs``."""
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = work(docs.withColumnsRenamed(own))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the classifier go."""
    prepared(spark)
    model = quality_rules.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return beside(docs, lambda d: quality_rules.rules(d, model).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from all but the earliest; a document left without a word goes too."""
    prepared(spark)
    out = beside(docs, lambda d: lineruns.dedup(d, keep_first=True))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    prepared(spark)
    return beside(docs, lambda d: neardup.dedup(d, k=5, percent=80))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document left without a word goes too."""
    prepared(spark)
    out = beside(docs, substring.dedup)
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their place in sequences of 2048 tokens."""
    prepared(spark)
    ids = packing.tokenise(F.col("text"), public_tokenizers.path("word_bpe_49k.json"), 1)
    pieces = packing.cut(docs.select("doc_id", ids.alias("ids")), "ids").withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, ["doc_id", "start", "ids_crc32"])


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("substring_dedup", passages),
    ("packing", sequences),
]
#: a trained classifier and tokenizers can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
