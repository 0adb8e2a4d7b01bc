"""Change logs as streams: RDF Patch and hextuple files applied to a kept state as they arrive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import LINES, patch_operations
from ..terms import term_schema


QUAD = [*"spog"]


def latest(changes: DataFrame, order: str, op: str = "op") -> DataFrame:
    """(s, p, o, g, op): the last operation, A or D, on each quad."""
    # As a flag and not as text, it is aggregated by hash where the order is a number; texts would have all rows sorted.
    return changes.groupBy(*QUAD).agg(F.when(F.max_by(F.col(op) == "A", order), "A").otherwise("D").alias("op"))


def merged(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """Quads after the last operations on some of them; columns of ``quads`` that the changes have too stay."""
    # The digests decide almost every comparison of a sort by one number; the terms are compared where they are equal.
    same = F.xxhash64(*[F.col(f"q.{c}") for c in quads.columns]) == F.xxhash64(*[F.col(f"r.{c}") for c in quads.columns])
    for c in quads.columns:
        same &= F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}"))
    kept = quads.alias("q").join(changes.alias("r"), same, "left_anti")
    return kept.unionByName(changes.where("op = 'A'").select(*quads.columns))


class State:
    """Quads under a shared folder: full snapshots, and between them the changes of each batch.

    A batch writes what it changes, a row for each quad with its last operation: A, or D as a tombstone. Reading
    joins the last snapshot once with all changes since. When the changes have grown to ``SHARE`` of the
    snapshot, or are ``MOST`` batches, a new snapshot is written, so what is written altogether follows
    the changes. Numbers are those of batches; earlier ones stay readable until ``vacuum``, and a batch
    that runs again writes its own again.
    """

    #: Changes of fewer bytes make no new snapshot.
    SHARE, MOST, LEAST = 0.5, 64, 1 << 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _snapshot(self, n: int) -> str:
        return f"{self.path}/snapshot-{n}"

    def _delta(self, n: int) -> str:
        return f"{self.path}/delta-{n}"

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._hadoop(f"{path}/_SUCCESS")
        return fs.exists(at)

    def _bytes(self, paths: list[str]) -> int:
        return sum(fs.getContentSummary(at).getLength() for fs, at in map(self._hadoop, paths))

    def _numbers(self, kind: str) -> list[int]:
        fs, root = self._hadoop(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-") and self._exists(f"{self.path}/{n}"))

    def last(self) -> int:
        return max([*self._numbers("snapshot"), *self._numbers("delta")], default=-1)

    def _since(self, n: int) -> tuple[int, list[int]]:
        """The snapshot to start from for a batch, and the batches with changes after it."""
        base = max([k for k in self._numbers("snapshot") if k <= n], default=-1)
        return base, [k for k in self._numbers("delta") if base < k <= n]

    def changes(self, batches: list[int]) -> DataFrame | None:
        """The last operation on each quad in some batches."""
        if not batches:
            return None
        if len(batches) == 1:  # a batch has one row for each quad
            return self.spark.read.parquet(self._delta(batches[0])).select(*QUAD, "op")
        parts = [self.spark.read.parquet(self._delta(k)).select(*QUAD, "op", F.lit(k).alias("batch")) for k in batches]
        return latest(reduce(DataFrame.unionAll, parts), "batch")

    def base(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], term_schema(*QUAD))
        return self.spark.read.parquet(self._snapshot(n)).select(*QUAD)

    def read(self, batch: int | None = None) -> DataFrame:
        """The quads after a batch; after the last one by default."""
        base, batches = self._since(self.last() if batch is None else batch)
        changes = self.changes(batches)
        return self.base(base) if changes is None else merged(self.base(base), changes)

    def write(self, batch: int, quads: DataFrame) -> None:
        """A full snapshot."""
        quads.select(*QUAD).write.mode("overwrite").parquet(self._snapshot(batch))

    def change(self, batch: int, changes: DataFrame) -> None:
        """A batch's last operation on each quad (s, p, o, g, op), with a new snapshot where the changes have grown."""
        changes.select(*QUAD, "op").write.mode("overwrite").parquet(self._delta(batch))
        base, batches = self._since(batch)
        if len(batches) > self.MOST or self._bytes([self._delta(k) for k in batches]) > self.SHARE * max(self._bytes([self._snapshot(base)] if base >= 0 else []), self.LEAST):
            self.write(batch, self.read(batch))

    def vacuum(self) -> None:
        """Remove what reading the last batch doesn't need."""
        base, _ = self._since(self.last())
        for kind in ("snapshot", "delta"):
            for n in self._numbers(kind):
                if n < base or (kind == "delta" and n == base):
                    fs, at = self._hadoop(f"{self.path}/{kind}-{n}")
                    fs.delete(at, True)


def apply_batches(spark: SparkSession, log: str, state: State, form: str = "patch"):
    """A handler for foreachBatch: the changes of the batch's lines, in the order of files and lines."""

    def apply(batch: DataFrame, n: int) -> None:
        if form == "patch":
            order = F.struct(F.col("modified"), F.col("file"), F.monotonically_increasing_id())
            changes = latest(patch_operations(batch, F.col("file"), order=order), "line_no")
        else:
            changes = LINES[form](batch, F.lit(""), True).select(*QUAD).distinct().withColumn("op", F.lit("A"))
        state.change(n, changes)

    return apply


def lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of lines with their file and its time; files come in the order of their times."""
    stream = spark.readStream.format("text").schema("value string").option("maxFilesPerTrigger", files_per_batch).load(path)
    return stream.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def replay(spark: SparkSession, log: str, path: str, form: str = "patch") -> DataFrame:
    """Apply all files of a change log that are there now; the quads that result."""
    state = State(spark, f"{path}/quads")
    run = lines(spark, log).writeStream.foreachBatch(apply_batches(spark, log, state, form)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return state.read()
