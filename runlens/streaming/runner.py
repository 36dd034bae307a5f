"""Run a streaming plan over what has arrived, with its checkpoint in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import writers


def append_run(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append mode into a Parquet table."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


FAN = 4


class Upserts:
    """The latest row of each key of a stream in update mode, as runs of levelled size.

    A micro-batch writes its changed rows as a run of level 0; ``FAN`` runs of a level become one of the next, with one row per
    key. So a key is written once per level, and a reader meets at most ``FAN`` runs per level, not all batches. Runs are named by
    their last batch and overwritten by it, so a batch that runs again changes nothing. A run is removed after its
    successor is whole; in between both say the same."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def _runs(self, level: int) -> list[int]:
        folder = f"{self.path}/level={level}"
        if not writers.exists(self.spark, folder):
            return []
        fs, p = writers._fs(self.spark, folder)
        found = [s.getPath() for s in fs.listStatus(p)]
        whole = [x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName().split("=")[1]) for x in whole)

    def _read(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*paths)
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("__batch")).alias("s")).select(*self.keys, "s.*")

    def save(self, df: DataFrame, batch: int) -> None:
        df.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/level=0/run={batch}")
        level = 0
        while len(runs := self._runs(level)) >= FAN:
            merged = self._read([f"{self.path}/level={level}/run={r}" for r in runs])
            merged.write.mode("overwrite").parquet(f"{self.path}/level={level + 1}/run={runs[-1]}")
            for r in runs:
                writers.delete(self.spark, f"{self.path}/level={level}/run={r}")
            level += 1

    def paths(self) -> list[str]:
        out, level = [], 0
        while writers.exists(self.spark, f"{self.path}/level={level}"):
            out += [f"{self.path}/level={level}/run={r}" for r in self._runs(level)]
            level += 1
        return out

    def table(self) -> DataFrame:
        return self._read(self.paths()).drop("__batch")


def update_run(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Update mode into ``Upserts``: the latest row per key is the result."""
    runs = Upserts(stream.sparkSession, out, keys)
    q = stream.writeStream.foreachBatch(runs.save).option("checkpointLocation", checkpoint).outputMode("update")
    q.trigger(availableNow=True).start().awaitTermination()
    return runs.table()


def each_batch(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, schema, path: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive. A micro-batch is bounded, in files or else in bytes, so that what one key brings into one
    batch is bounded too."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", 256 * 1024 * 1024)
    return reader.parquet(path)
