"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators rely on. All are runtime settings, so they can be applied to a session
# that somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also split a hot join key when that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merging two change maps: the later value wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # the first k rows of a key are cut on the map side up to the largest cap of a recording
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # a plan knows a stored table by its packed size, which may be a hundredth of its rows: beyond this, a side is broadcast
    # only if it was measured, and no side comes to the driver that grows with the input
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    # ten thousand whole texts are too many for a Python worker
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("runlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master; on a cluster the setting is required,
    because executors must be able to read back what another one wrote.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="runlens-")
    sc.setCheckpointDir(named)
    return named


def scratch_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), f"runlens-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused, so nothing is overwritten."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop with a reliable checkpoint: for the narrow state that a loop carries along."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write a wide table once to the shared folder and read it back.

    It survives the loss of any executor, is read with column pruning, and keeps the plans of multi-pass operators
    small. ``drop_scratch`` removes it when the job is done. ``options`` are those of the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.is_written = True
    return out


def is_written(df: DataFrame) -> bool:
    """Whether this very table came from ``materialise``: it can be read again for the price of a scan."""
    return getattr(df, "__dict__", {}).get("is_written", False)


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    return df if is_written(df) else materialise(df, label)


def drop_scratch(spark: SparkSession) -> None:
    """Remove everything this application wrote below the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
