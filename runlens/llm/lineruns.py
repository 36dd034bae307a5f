"""Line dedup with levelled sorted runs.

A run is a table of (line digest, number of documents), bucketed and sorted by digest. Documents come in batches. Each
batch is reduced to counts per digest, merge-anti-joined with what the runs already hold as settled (counted often
enough, nothing more to learn), and added as a run of level 0; bucketed runs are not shuffled for that. When a level
has ``fanout`` runs they are compacted into one of the next level, which settles more digests. A digest's count is the
sum over the runs; lines whose digest reaches the threshold go from every document.

Digests are counted per task before the shuffle, so a line that is everywhere costs one row per task. Digests have
128 bits. Empty keys aren't counted. Null and empty texts are one empty line and stay. Rows repeated are documents each.

With ``keep_first`` a common line stays in its earliest document (the smallest id, null last, then the text's hash), so
no line goes from the corpus altogether; rows equal in id and text keep it alike.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .linekeys import digest, key, lines
from .rows import ID, TIE, give, keyed

LEAST_DOCS, BATCHES, FANOUT = 10, 4, 3


class LineRuns:
    """The runs, in the shared folder and, until ``close``, in the catalog. They can be kept between calls to add later
    batches."""

    def __init__(self, spark: SparkSession, settled: int, fanout: int = FANOUT):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: table and path of the runs of each level
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        counts.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        """Take runs out of the catalog; their files stay in the shared folder, as external tables do."""
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Leave nothing in the catalog. ``counts`` still reads the files; no batch can be added any more."""
        self._forget([r for level in self.levels for r in level])

    def add(self, digests: DataFrame) -> None:
        """``digests``: one row per document and distinct line of it."""
        new = digests.groupBy("digest").agg(F.count("*").alias("n"))
        for name, _ in (r for level in self.levels for r in level):
            new = new.join(self.spark.table(name).where(F.col("n") >= self.settled), "digest", "left_anti")
        self._write(new, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._merged(old), level + 1)
                self._forget(old)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Sums over runs. They are read as plain files: the union of bucketed columnar scans keeps the buckets' claim
        of partitioning but not their alignment, so sums over it would come out in parts."""
        return self.spark.read.schema("digest binary, n long").parquet(*[path for _, path in runs]).groupBy("digest").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        return self._merged([r for level in self.levels for r in level])


def rebuild(text: Column, dropped: Column) -> Column:
    """Text without the lines whose digest is in ``dropped``, and how many went; null ``dropped``: all stay."""

    @F.arrow_udf("text string, n_dropped long")
    def kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out, n = [], []
        for t, g in zip(texts, gone):
            t, g = t.as_py() or "", g.as_py()
            if g:
                own, g = t.split("\n"), set(g)
                left = [line for line in own if digest(line) not in g]
                out.append("\n".join(left))
                n.append(len(own) - len(left))
            else:
                out.append(t)
                n.append(0)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64())], ["text", "n_dropped"])

    return kept(text, dropped)


def dedup(docs: DataFrame, key_col: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = 1, batches: int = BATCHES, keep_first: bool = False) -> DataFrame:
    """All columns of ``docs``, the text without common lines, with ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    docs = keyed(docs, key_col, text)
    wanted = F.filter(F.transform(lines(text), key), lambda k: F.char_length(k) >= least_chars)
    each = docs.select(ID, TIE, F.explode(F.array_distinct(F.transform(wanted, F.md5))).alias("d"))
    each = each.select(ID, TIE, F.unhex("d").alias("digest"), F.pmod(TIE, F.lit(batches)).cast("int").alias("batch"))
    held = materialise(each, "lines")
    runs = LineRuns(spark, least_docs)
    for i in range(batches):
        runs.add(held.where(F.col("batch") == i))
    # written, so that the join below reads both sides by a shuffle of their own and a hot digest can be split
    common = materialise(runs.counts().where(F.col("n") >= least_docs).select("digest"), "common")
    runs.close()
    hit = held.select(ID, TIE, "digest").join(common, "digest", "left_semi")
    if keep_first:
        hit, place = materialise(hit, "hit"), F.struct(F.col(ID).isNull().alias("late"), ID, TIE)
        first = materialise(hit.groupBy("digest").agg(F.min(place).alias("first")), "first")
        hit = hit.join(first, "digest").where(~place.eqNullSafe(F.col("first")))
    per_doc = hit.groupBy(ID, TIE).agg(F.collect_set("digest").alias("__gone"))
    joined = give(docs, per_doc)
    made = rebuild(F.col(text), F.col("__gone"))
    own = [c for c in docs.columns if c not in (ID, TIE, text, "n_lines", "n_dropped")]
    out = joined.select(*own, F.size(lines(text)).cast("long").alias("n_lines"), made.alias("__m"))
    return out.select(*own, "n_lines", F.col("__m.n_dropped").alias("n_dropped"), F.col("__m.text").alias(text))
