"""Burst sessions: payments of one sender that follow each other without a longer pause.

A session is held as a partial result (first and last payment, count, volume, largest amount). Partial results of
any slices of the payments merge exactly, in any order: two belong together if the pause between them is not longer than
the gap. So a sender with a third of all payments is cut by the hour first, and a stream can store the partial
results of each batch, with a late payment joining what it bridges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP = "30 minutes"
#: Payments that make a session a burst.
BURST = 3

PARTIAL_COLUMNS = ["sender_id", "first_ts", "last_ts", "txn_count", "volume", "largest"]


def sent(payments: DataFrame) -> DataFrame:
    """(sender_id, ts, amount_eur) of the payments that name a sender and a time."""
    sender = F.coalesce("sender_customer_no", "sender_id")
    return payments.select(sender.alias("sender_id"), "ts", F.col("amount_eur").cast("decimal(18,2)").alias("amount_eur")).filter(
        F.col("sender_id").isNotNull() & F.col("ts").isNotNull()
    )


def _sums(grouped) -> DataFrame:
    return grouped.agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount_eur").cast("decimal(28,2)").alias("volume"),
        F.max("amount_eur").alias("largest"),
    )


def partial_sessions(payments: DataFrame, gap: str = GAP) -> DataFrame:
    """Sessions within each hour of each sender: the hour is a grouping key, so no group grows with the history."""
    keys = ["sender_id", F.date_trunc("hour", "ts").alias("hour"), F.session_window("ts", gap).alias("session")]
    return _sums(sent(payments).groupBy(*keys)).select(*PARTIAL_COLUMNS)


def merge_sessions(partials: DataFrame, gap: str = GAP) -> DataFrame:
    """Partial sessions of any slices joined to whole ones; a pause longer than the gap ends a session."""
    by_time = Window.partitionBy("sender_id").orderBy("first_ts", "last_ts")
    before = F.max("last_ts").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("first_ts") <= before + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    numbered = partials.withColumn("_new", starts).withColumn("_session", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("sender_id", "_session").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("txn_count").alias("txn_count"),
        F.sum("volume").cast("decimal(28,2)").alias("volume"),
        F.max("largest").alias("largest"),
    ).drop("_session")


def sessions(payments: DataFrame, gap: str = GAP) -> DataFrame:
    """All sessions of all senders. A sender costs one row per hour and session after the first shuffle."""
    return merge_sessions(partial_sessions(payments, gap), gap)


def bursts(found: DataFrame, least: int = BURST, closed_by: Column | None = None, gap: str = GAP) -> DataFrame:
    """Sessions of at least ``least`` payments with their length in seconds.

    With ``closed_by`` only sessions that no payment from then on can extend are kept.
    """
    if closed_by is not None:
        found = found.filter(F.col("last_ts") + F.expr(f"INTERVAL {gap}") < closed_by)
    seconds = ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6).alias("seconds")
    return found.filter(F.col("txn_count") >= least).select(*PARTIAL_COLUMNS, seconds)
