"""The whole payment pipeline per micro-batch.

Stages read and write file tables below one folder. A failing stage fails the batch, which then runs
again as a whole; every write is owned by the batch id, so running twice changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewarden.config import GLOBAL_ALERT_CAP, RULE_ALERT_CAP, load_rules
from tidewarden.functions.calendar import hours_before
from tidewarden.operators import alerts, enrich, normalize, rules, windows
from tidewarden.operators.analytics import latest_per
from tidewarden.streaming.queries import alert_window, start
from tidewarden.streaming.tables import UpdateLog, exists, read_before, write_batch

METRIC_KEYS = ["customer_id", "window_type", "window_start"]
HISTORY_DAYS = 31


@dataclass
class PaymentPipeline:
    """Normalise, store, enrich, measure, detect, budget, prioritise and archive one batch of payments.

    Metrics are measured from the stored history of the customers in the batch. With ``metrics_source``
    they come from elsewhere, such as the table a stateful metrics stream keeps; the history is then not
    read at all, which is the choice for a high payment rate.
    """

    spark: SparkSession
    base: str
    customers: DataFrame
    rules_path: str | None = None
    global_cap: int | None = GLOBAL_ALERT_CAP
    rule_cap: int | None = RULE_ALERT_CAP
    predicate: Column | None = None
    metrics_source: Callable[[], DataFrame] | None = None
    lag: Column = field(default_factory=lambda: F.expr("INTERVAL 60 SECONDS"))

    def path(self, table: str) -> str:
        return os.path.join(self.base, table)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def metrics(self) -> DataFrame:
        return self._metrics_log().rows()

    def _metrics_log(self) -> UpdateLog:
        """Metrics by batch, the newest per key counting; folded now and then."""
        return UpdateLog(self.spark, self.path("metrics"), lambda log: latest_per(log, METRIC_KEYS, [F.desc("batch_id")]))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Handle one batch of wire payments. Thresholds are read anew for every batch."""
        if batch.isEmpty():
            return
        cfg = load_rules(self.rules_path)
        spark = batch.sparkSession
        txns = normalize.normalize(batch, F.to_timestamp("ts") + F.expr("INTERVAL 30 SECONDS"))
        write_batch(txns, self.path("transactions"), batch_id, day_of="ts")

        stored = spark.read.parquet(self.path("transactions")).filter(F.col("batch_id") <= batch_id)
        # Read back what was stored: a late file listing or a lost executor cannot change the batch.
        txns = stored.filter(F.col("batch_id") == batch_id).select(*normalize.TXN_COLUMNS)
        write_batch(enrich.enrich_kyc(txns, self.customers), self.path("enriched"), batch_id, day_of="ts")
        first_day, last_ts = txns.agg(F.min(F.to_date("ts")), F.max("ts")).first()

        since = F.date_sub(F.lit(first_day), HISTORY_DAYS)
        if self.metrics_source is None:
            current = self._measure(txns, stored, since, last_ts, batch_id)
        else:
            current = self.metrics_source().filter(F.col("window_start") >= since)

        found = rules.evaluate_rules(
            txns, current, self.customers, cfg, flagged_at=F.col("ts") + self.lag, predicate=self.predicate
        )
        scored = alerts.alert_priority(found, self.customers).withColumn(
            "alert_window", alert_window(F.col("window_type"), F.col("ts"))
        )
        # Days before the history cannot hold one that matters: their folders are not read.
        raised = read_before(spark, self.path("flags"), batch_id, scored, since)
        # Only windows and days this batch can touch matter for repeats.
        same_window = raised.filter(
            (F.col("rule_name") != "dormant_reactivation") & (F.col("alert_window") >= since)
        ).select("customer_id", "rule_name", "alert_window")
        same_txn = raised.filter(F.col("ts") >= F.lit(first_day)).select("txn_id", "rule_name")
        fresh = scored.join(same_window, ["customer_id", "rule_name", "alert_window"], "left_anti").join(
            same_txn, ["txn_id", "rule_name"], "left_anti"
        )
        if self.global_cap is not None and self.rule_cap is not None:
            counts = (
                raised.filter(F.col("flagged_at") >= hours_before(F.lit(last_ts), 24))
                .groupBy("rule_name")
                .agg(F.count(F.lit(1)).alias("alert_count"))
            )
            fresh = alerts.apply_budget(fresh, counts, self.global_cap, self.rule_cap)
        write_batch(fresh.select(*scored.columns), self.path("flags"), batch_id, day_of="ts")

        if exists(spark, self.path("flags")):
            kept = spark.read.parquet(self.path("flags")).filter(F.col("batch_id") == batch_id).drop("day")
            known = stored.select(*normalize.TXN_COLUMNS)
            write_batch(alerts.archive(kept, known, F.lit(last_ts)), self.path("archive"), batch_id)

    def _measure(
        self, txns: DataFrame, stored: DataFrame, since: Column, last_ts, batch_id: int
    ) -> DataFrame:
        """Window metrics and profiles of the customers in the batch, stored under its id."""
        senders = txns.select(F.coalesce("sender_customer_no", "sender_id").alias("sender_key"))
        touched = (
            senders.unionByName(txns.select(normalize.alert_subject().alias("sender_key")))
            .filter(F.col("sender_key").isNotNull())
            .distinct()
        )
        # The day partitions bound the scan; the few customers of a batch are broadcast if small.
        history = (
            stored.filter(F.col("day") >= since)
            .withColumn("sender_key", F.coalesce("sender_customer_no", "sender_id"))
            .join(touched, "sender_key", "left_semi")
        )
        measured = windows.window_metrics(history, F.lit(last_ts))
        # Windows that began before the history are incomplete and stay as stored.
        log = self._metrics_log()
        log.write(measured.filter(F.col("window_start") >= since), batch_id)
        write_batch(windows.behavior_30d(history, F.lit(last_ts)), self.path("behavior"), batch_id)
        return log.rows() if batch_id <= log.through() else log.rows(batch_id)

    def run(self, payments: DataFrame, continuous: bool = False) -> StreamingQuery:
        """Start the pipeline on a stream of wire payments."""
        return start(payments, self.process, self.path("checkpoint"), continuous=continuous)
