"""File tables written batch by batch.

Each micro-batch owns the folder ``batch_id=<n>`` of a table and replaces it as a whole, so a batch that runs
again after a failure leaves only the rows of its last run, even if these are fewer or none.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.operators.analytics import latest_per
from tidewarden.sources.versions import VersionedTable


def write_batch(df: DataFrame, path: str, batch_id: int, day_of: str | None = None) -> None:
    """Replace the rows of one batch, in partitions by the date of ``day_of`` if given.

    The writer sorts a task's rows by day. They are dealt by day first, in pieces of the size that adaptive execution
    advises, so that no task sorts what happens to come out of one input file or one join.
    """
    owned = df.withColumn("day", F.to_date(day_of)).hint("rebalance", F.col("day")) if day_of else df
    writer = owned.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if day_of:
        writer = writer.partitionBy("day")
    writer.parquet(f"{path}/batch_id={int(batch_id)}")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.exists(hadoop))


def read_before(spark: SparkSession, path: str, batch_id: int, like: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows of earlier batches; an empty table with the columns of ``like`` before the first one.

    ``since`` leaves out the folders of earlier days in a table that is laid out by day.
    """
    if not exists(spark, path):
        return like.limit(0)
    stored = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
    if since is not None:
        stored = stored.filter(F.col("day") >= since)
    return stored.select(*like.columns)


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Keyed view of an update log: the row of the newest batch per key."""
    return latest_per(spark.read.parquet(path), list(keys), [F.desc("batch_id")]).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: Sequence[str], target: str, through: int) -> None:
    """Fold the update log into one batch at ``target``."""
    write_batch(latest_rows(spark, path, keys), target, through)


COMPACT_EVERY = 64


class UpdateLog:
    """A table kept as one folder per batch, folded into one version every ``every`` batches.

    ``fold`` turns rows of several batches (with ``batch_id``) into the rows that count, and folding folded rows with
    later ones must give the same. The folded version is published with the number of the last batch it holds before
    the folders of these batches go, so a reader or a failure in between finds each row once.
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY):
        self.spark, self.fold, self.every = spark, fold, every
        self.log, self.folded = os.path.join(path, "log"), VersionedTable(spark, os.path.join(path, "folded"))

    def through(self) -> int:
        """The last batch that the folded version holds."""
        version = self.folded.current()
        return version.notes["through"] if version else -1

    def rows(self, batch_id: int | None = None) -> DataFrame:
        """The rows of one batch as they were written, or the folded rows of all."""
        if batch_id is not None:
            return self.spark.read.parquet(self.log).filter(F.col("batch_id") == batch_id).drop("batch_id")
        through, parts = self.through(), []
        if through >= 0:
            parts.append(self.folded.read())
        if exists(self.spark, self.log) and self._later(through):
            parts.append(self.spark.read.parquet(self.log).filter(F.col("batch_id") > through))
        if not parts:
            raise ValueError(f"{self.log}: no batch was written")
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.fold(both).drop("batch_id")

    def _batches(self) -> list[int]:
        listed = self.folded._files.listStatus(self.folded._hadoop(self.log))
        names = [s.getPath().getName() for s in listed]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))

    def _later(self, through: int) -> list[int]:
        return [n for n in self._batches() if n > through]

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Store a batch; one that runs again after it was folded changes nothing."""
        if batch_id <= self.through():
            return
        write_batch(df, self.log, batch_id)
        # The batch itself stays as it was written, for the stages that follow it.
        if batch_id % self.every == 0 and batch_id > 0:
            self.compact(batch_id - 1)

    def compact(self, through: int) -> None:
        """Fold all batches up to ``through`` into a new version, then delete their folders."""
        before = self.through()
        if through <= before:
            return
        later = self.spark.read.parquet(self.log).filter((F.col("batch_id") > before) & (F.col("batch_id") <= through))
        held = self.fold(later if before < 0 else self.folded.read().unionByName(later))
        self.folded.publish(held.drop("batch_id").withColumn("batch_id", F.lit(through)), through=through)
        for n in self._batches():
            if n <= through:
                self.folded._files.delete(self.folded._hadoop(f"{self.log}/batch_id={n}"), True)
        self.folded.vacuum(keep=2)
