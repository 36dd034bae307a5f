"""Safe mode: writes land in a staging area that mirrors the target, and every effect becomes a ledger row."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql_text import kind, one_line, strip_comments, written_table
from .writers import delete, exists, move

LEDGER = "seq long, kind string, op string, target string, handled string, n_rows long, sandbox string"


class Staging:
    """One job's staging area below ``root``. ``staged`` maps a target that the job has touched to its layers."""

    def __init__(self, spark: SparkSession, root: str, live: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.live = live
        self.staged: dict[str, list[str]] = {}
        self.seq = 0

    def path_for(self, target: str) -> str:
        """The staged path mirrors the absolute target; a new version per write, so a copy that is being read stays."""
        inside = target.replace("://", "/").replace(":", "").lstrip("/")
        return f"{self.root}/files/{inside}/v-{uuid.uuid4().hex}"

    def record(self, kind: str, op: str, target: str, handled: str | None = None, n_rows: int | None = None, sandbox: str | None = None) -> None:
        """One ledger row per effect, appended at once: what was recorded survives a job that fails later."""
        self.seq += 1
        row = [(self.seq, kind, op, target, handled, n_rows, sandbox)]
        self.spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")

    def write(self, df: DataFrame, target: str, mode: str = "overwrite") -> str:
        """Write to the staging area, or to the target itself in live mode. An append is staged as what it adds; the target is
        neither changed nor copied."""
        if self.live:
            df.write.mode(mode).parquet(target)
            self.record("file", "write", target)
            return target
        before = self.layers(target) if mode == "append" else []
        path = self.path_for(target)
        df.write.parquet(path)
        self.staged[target] = [*before, path]
        self.record("file", "write", target, "redirected", sandbox=path)
        return path

    def layers(self, target: str) -> list[str]:
        """The tables that make up what this job sees as ``target``: the real one, unless overwritten, and what was appended."""
        return self.staged.get(target) or ([target] if exists(self.spark, target) else [])

    def seen(self, target: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in self.layers(target) or [target]])

    def read(self, target: str) -> DataFrame:
        """A target already written in this job resolves to the union of its layers."""
        self.record("file", "read", target, "read-redirected" if target in self.staged else None)
        return self.seen(target)

    def has(self, target: str) -> bool:
        return target in self.staged or exists(self.spark, target)

    def remove(self, target: str) -> bool:
        """A staged copy is dropped; the delete of a real target is refused and recorded."""
        if self.live:
            delete(self.spark, target)
            self.record("file", "remove", target)
            return True
        layers = self.staged.pop(target, [])
        for path in layers:
            if path.startswith(f"{self.root}/files/"):
                delete(self.spark, path)
        self.record("file", "remove", target, "redirected" if layers else "blocked")
        return bool(layers)

    def rename(self, source: str, target: str) -> str:
        """The target has the source's layers from now on; a real source stays where it is and isn't copied."""
        label = f"{source} -> {target}"
        if self.live:
            move(self.spark, source, target)
            self.record("file", "rename", label)
            return target
        layers = self.layers(source)
        if not layers:
            raise FileNotFoundError(source)
        self.staged.pop(source, None)
        self.staged[target] = layers
        self.record("file", "rename", label, "redirected")
        return layers[-1]

    def working_copy(self, target: str) -> DataFrame:
        """A private view of a table for this job: the real table below what the job writes, nothing is copied."""
        if target not in self.staged:
            self.staged[target] = [target]
            self.record("database", "connect", target, "working-copy")
        return self.seen(target)

    def shadow(self, statements: DataFrame, database: str) -> str:
        """Writing statements (``sql``, ``params``) are kept as JSON lines per table instead of being run."""
        text = strip_comments(F.col("sql"))
        writes = statements.filter(kind(F.col("sql")) == "write").select(
            F.coalesce(written_table(text), F.lit("unknown")).alias("tbl"), one_line(text).alias("sql"), "params"
        )
        path = f"{self.root}/db_writes/{database}"
        writes.write.mode("append").partitionBy("tbl").json(path)
        self.record("database", "write", database, "shadowed", sandbox=path)
        return path
