"""Streams that keep what comes late.

A watermark lets Spark forget state, and rows behind it vanish. Here each batch stores partial results that merge
exactly whatever the order of arrival, and a row behind the newest payment of the earlier batches by more than
``lateness`` is stored like the others and counted as late. All tables are owned by the batch id, so a batch that runs
again replaces what it wrote. The names start with what they hold: sessions, minutes, payments, newest.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.config import RULES
from tidewarden.operators import analytics, sessions
from tidewarden.streaming.queries import LATENESS, start
from tidewarden.streaming.tables import exists, write_batch


def is_late(spark: SparkSession, base: str, batch_id: int, ts: Column, lateness: str = LATENESS) -> Column:
    """Whether a payment lies behind the newest one of the earlier batches by more than ``lateness``."""
    path, newest = os.path.join(base, "newest"), None
    if exists(spark, path):
        stored = spark.read.schema("newest timestamp, batch_id int").parquet(path)
        newest = stored.filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
    return F.coalesce(ts < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}"), F.lit(False))


def _keep_newest(rows: DataFrame, base: str, batch_id: int) -> None:
    write_batch(rows.agg(F.max("ts").cast("timestamp").alias("newest")), os.path.join(base, "newest"), batch_id)


# sessions


def keep_sessions(batch: DataFrame, base: str, batch_id: int, gap: str = sessions.GAP) -> None:
    """Store the partial sessions of one batch."""
    write_batch(sessions.partial_sessions(batch, gap), os.path.join(base, "sessions"), batch_id)


def kept_sessions(spark: SparkSession, base: str, gap: str = sessions.GAP) -> DataFrame:
    """The sessions of all batches so far; a late payment joins the sessions it lies between."""
    return sessions.merge_sessions(spark.read.parquet(os.path.join(base, "sessions")).drop("batch_id"), gap)


def run_sessions(payments: DataFrame, base: str, gap: str = sessions.GAP) -> DataFrame:
    query = start(payments, lambda batch, n: keep_sessions(batch, base, n, gap), os.path.join(base, "checkpoint"))
    query.awaitTermination()
    return kept_sessions(payments.sparkSession, base, gap)


def stream_sessions(payments: DataFrame, gap: str = sessions.GAP, lateness: str = LATENESS, least: int = sessions.BURST) -> DataFrame:
    """Bursts as a stream in append mode: each is given out once, when the watermark has passed its gap."""
    found = (
        sessions.sent(payments)
        .withWatermark("ts", lateness)
        .groupBy("sender_id", F.session_window("ts", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount_eur").cast("decimal(28,2)").alias("volume"))
    )
    last = F.col("session.end") - F.expr(f"INTERVAL {gap}")
    return found.filter(F.col("txn_count") >= least).select(
        "sender_id", F.col("session.start").alias("first_ts"), last.alias("last_ts"), "txn_count", "volume"
    )


# velocity


def keep_minutes(batch: DataFrame, base: str, batch_id: int, lateness: str = LATENESS) -> None:
    """Store payments per account and minute, and how many of them came late."""
    late = is_late(batch.sparkSession, base, batch_id, F.col("ts"), lateness)
    account = F.coalesce("sender_customer_no", "sender_id")
    rows = batch.filter(account.isNotNull() & F.col("ts").isNotNull())
    minutes = rows.groupBy(account.alias("account_id"), F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late")
    )
    write_batch(minutes, os.path.join(base, "minutes"), batch_id)
    _keep_newest(rows, base, batch_id)


def kept_velocity(spark: SparkSession, base: str, cfg: dict = RULES) -> DataFrame:
    """Sliding windows above the allowed number of payments, late ones included, and how many of these came late."""
    length, most = int(cfg["velocity"]["window_minutes"]), int(cfg["velocity"]["max_txns_per_account"])
    minutes = spark.read.parquet(os.path.join(base, "minutes")).groupBy("account_id", "minute").agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late")
    )
    return (
        minutes.groupBy("account_id", F.window("minute", f"{length} minutes", "1 minute").alias("w"))
        .agg(F.sum("n").alias("txn_count"), F.sum("n_late").alias("late_count"))
        .filter(F.col("txn_count") > most)
        .select("account_id", F.col("w.start").alias("window_start"), "txn_count", "late_count")
    )


def run_velocity(payments: DataFrame, base: str, cfg: dict = RULES, lateness: str = LATENESS) -> DataFrame:
    query = start(payments, lambda batch, n: keep_minutes(batch, base, n, lateness), os.path.join(base, "checkpoint"))
    query.awaitTermination()
    return kept_velocity(payments.sparkSession, base, cfg)


# duplicates


def keep_once(batch: DataFrame, base: str, batch_id: int, lateness: str = LATENESS) -> None:
    """Store each payment the first time its id arrives, by day, marked if late.

    A repeat has the time of its original, so only the stored days that the batch touches are searched. Repeats are
    counted by batch.
    """
    spark, path = batch.sparkSession, os.path.join(base, "payments")
    late = is_late(spark, base, batch_id, F.col("ts"), lateness)
    rows = batch.filter(F.col("txn_id").isNotNull() & F.col("ts").isNotNull())
    fresh = rows.dropDuplicates(["txn_id"])
    if exists(spark, path):
        seen = spark.read.parquet(path).filter(F.col("batch_id") < batch_id)
        days = rows.select(F.to_date("ts").alias("day")).distinct()
        fresh = fresh.join(seen.join(days, "day", "left_semi").select("txn_id"), "txn_id", "left_anti")
    write_batch(fresh.withColumn("late", late), path, batch_id, day_of="ts")
    kept = spark.read.parquet(path).filter(F.col("batch_id") == batch_id).agg(F.count(F.lit(1)).alias("kept"))
    counts = analytics.one_row(rows.agg(F.count(F.lit(1)).alias("arrived")), kept)
    write_batch(counts.withColumn("repeats", F.col("arrived") - F.col("kept")), os.path.join(base, "counts"), batch_id)
    _keep_newest(rows, base, batch_id)


def run_once(payments: DataFrame, base: str, lateness: str = LATENESS) -> DataFrame:
    """All payments so far, each once, with ``late`` and ``batch_id``."""
    query = start(payments, lambda batch, n: keep_once(batch, base, n, lateness), os.path.join(base, "checkpoint"))
    query.awaitTermination()
    return payments.sparkSession.read.parquet(os.path.join(base, "payments")).drop("day")
