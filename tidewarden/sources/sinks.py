"""Sinks and keyed table updates on file tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.functions.calendar import days_before
from tidewarden.sources.versions import Version, VersionedTable

EXPORT_KEEP_DAYS = 7


def append(df: DataFrame, path: str, day_of: str | None = "ts") -> None:
    """Append, laid out by calendar day where the table has a time column."""
    if day_of and day_of in df.columns:
        df.withColumn("day", F.to_date(day_of)).write.mode("append").partitionBy("day").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace the whole table. ``df`` must not read from ``path``."""
    df.write.mode("overwrite").parquet(path)


def overwrite_days(df: DataFrame, path: str, day_of: str = "ts") -> None:
    """Replace only the calendar days present in ``df``; a repeated batch leaves the same table."""
    (
        df.withColumn("day", F.to_date(day_of))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def upsert(
    existing: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[Column]
) -> DataFrame:
    """Keyed upsert into a table with unique, non-null keys: an update replaces the stored row.

    Of several updates of a key the first in ``order_by`` counts. Stored rows only pass an anti join on
    the update keys, so a large table is not shuffled for a few updates.
    """
    newest = Window.partitionBy(*keys).orderBy(*order_by)
    # ``row_number() = 1`` is trimmed before the shuffle: a hot key sends one row per task.
    winners = updates.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")
    kept = existing.join(updates.select(*keys), list(keys), "left_anti")
    return kept.unionByName(winners, allowMissingColumns=True)


def insert_new(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; the first of repeated keys is kept."""
    return new.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def export_gold(df: DataFrame, base: str, table: str, run_id: str) -> str:
    """Write one run of a gold table and refresh its current copy; returns the run's path."""
    run_path = os.path.join(base, table, f"run_id={run_id}")
    df.write.mode("overwrite").parquet(run_path)
    current = df.sparkSession.read.parquet(run_path)
    overwrite(current, os.path.join(base, f"{table}_current"))
    return run_path


def publish_gold(df: DataFrame, base: str, table: str, run_id: str) -> Version:
    """Write one run of a gold table and make it the current version, without a moment in which readers find none.

    The current copy is read by ``VersionedTable(spark, f"{base}/{table}_current").read()``.
    """
    run_path = os.path.join(base, table, f"run_id={run_id}")
    df.write.mode("overwrite").parquet(run_path)
    return publish_snapshot(df.sparkSession.read.schema(df.schema).parquet(run_path), os.path.join(base, f"{table}_current"))


def publish_snapshot(df: DataFrame, path: str, keep: int = 2) -> Version:
    """Make ``df`` the current snapshot at ``path``; the last ``keep`` versions stay readable."""
    table = VersionedTable(df.sparkSession, path)
    version = table.publish(df)
    table.vacuum(keep)
    return version


def prune_runs(listing: DataFrame, as_of, days: int = EXPORT_KEEP_DAYS) -> DataFrame:
    """Per table: how many exported runs are older than the limit and how many stay."""
    stale = F.coalesce(F.col("updated_at") < days_before(as_of, days), F.lit(False))
    return listing.groupBy("table_name").agg(
        F.count_if(stale).alias("deleted"), F.count_if(~stale).alias("kept")
    )


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_snapshot(df: DataFrame, path: str) -> None:
    """Keep only the newest score snapshot."""
    overwrite(df, path)


def append_run(df: DataFrame, path: str) -> None:
    """One more row in the model run registry."""
    df.write.mode("append").parquet(path)
