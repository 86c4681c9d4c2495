"""Headline queries over one data folder; prints one JSON line.

``rule_pipeline`` is the comparable figure: all payments through window metrics, every rule, priority and
budget as one batch, from the raw files. Each query is timed after one warm-up of the session, on its own
plan, with the result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.operators import alerts, windows
from tidewarden.plans import registry
from tidewarden.plans.workspace import Workspace
from tidewarden.session import build_session

BASE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "window_metrics", "window_metrics_asof", "behavior_30d", "evaluate_rules", "rule_mule_inbound",
    "apply_budget", "archive_counts", "open_alerts", "gold_customer_risk_profile", "gold_daily_fraud_summary",
    "segmentation_segment", "geo_corridors", "risk_incidence", "customer_360", "dq_scorecard", "job_health",
    "resolve_targets", "resolve_targets_all", "customer_txns_laid", "burst_sessions", "party_join_heavy", "features", "roc_curve", "anomaly_rank", "isolation_forest", "stream_window_metrics",
]


def rule_pipeline(w: Workspace) -> DataFrame:
    scored = alerts.alert_priority(w.evaluated(), w.customers)
    none_yet = scored.limit(0).groupBy("rule_name").agg(F.count(F.lit(1)).alias("alert_count"))
    return alerts.apply_budget(scored, none_yet)


def lineitem_metrics(w: Workspace) -> DataFrame:
    """Window metrics over the larger table: order lines as payments of a customer to a supplier."""
    lines, orders = w.table("lineitem"), w.table("orders")
    paid = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,2)")
    payments = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("sender_id"),
        F.lit(None).cast("string").alias("sender_customer_no"),
        F.col("l_suppkey").cast("string").alias("receiver_id"),
        F.lit(None).cast("string").alias("receiver_customer_no"),
        paid.alias("amount_eur"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    return windows.window_metrics(payments, w.as_of)


def timed(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        int(CPUS),
        **{
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    Workspace(spark, BASE).events.agg(F.count(F.lit(1))).collect()
    took: dict[str, float] = {}

    def clock(name: str, job) -> None:
        begin = time.perf_counter()
        job()
        took[name] = round(time.perf_counter() - begin, 3)

    clock("rule_pipeline", lambda: timed(rule_pipeline(Workspace(spark, BASE))))
    clock("lineitem_metrics", lambda: timed(lineitem_metrics(Workspace(spark, BASE))))
    # The stored lookup index, laid-out payments, alerts, metrics and scores are built once and timed as such.
    clock("store_lookup", lambda: Workspace(spark, BASE).lookup)
    clock("store_laid", lambda: Workspace(spark, BASE).laid)
    clock("store_silver", lambda: [getattr(Workspace(spark, BASE), t) for t in ("metrics", "flags", "scores")])
    for name in HEADLINE:
        clock(name, lambda: timed(registry.run(name, spark, BASE)))
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(BASE.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
