"""Audit metrics, consistency, freshness, retention and the event log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.config import FRESHNESS, METRICS_ROW_CAP, RETENTION
from tidewarden.functions.calendar import age_seconds, as_col, hours_before, midnight, minutes_before
from tidewarden.operators.analytics import one_row
from tidewarden.operators.alerts import page


def _metric_rows(df: DataFrame, recorded_at) -> DataFrame:
    return df.select(
        "metric_key", F.col("metric_value").cast("bigint").alias("metric_value"), "metric_detail",
        as_col(recorded_at).alias("recorded_at"),
    )


def pipeline_audit(flags: DataFrame, customers: DataFrame, acquired: DataFrame, as_of) -> DataFrame:
    """Hourly snapshot in long format: alerts per rule and in total, customer counts."""
    per_rule = (
        flags.filter(F.col("flagged_at") >= hours_before(as_of, 24))
        .rollup("rule_name")
        .agg(F.count(F.lit(1)).alias("metric_value"))
        .select(
            F.concat(F.lit("alerts_24h_"), F.coalesce("rule_name", F.lit("total"))).alias("metric_key"),
            "metric_value",
            F.col("rule_name").alias("metric_detail"),
        )
    )
    people = customers.agg(
        F.count(F.lit(1)).alias("customers_total"),
        F.count_if(F.col("customer_status") == "active").alias("customers_active"),
    ).unpivot([], ["customers_total", "customers_active"], "metric_key", "metric_value")
    today = acquired.filter(F.col("acquired_at") >= midnight(as_of)).agg(
        F.count(F.lit(1)).alias("metric_value")
    ).select(F.lit("customers_acquired_today").alias("metric_key"), "metric_value")
    rows = per_rule.unionByName(people, allowMissingColumns=True).unionByName(today, allowMissingColumns=True)
    return _metric_rows(rows, as_of)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Newest value per metric key."""
    return (
        metrics.groupBy("metric_key")
        .agg(F.max_by(F.struct("metric_value", "metric_detail", "recorded_at"), "recorded_at").alias("m"))
        .select("metric_key", "m.metric_value", "m.metric_detail", "m.recorded_at")
    )


def consistency_checks(
    customers: DataFrame, acquired: DataFrame, metrics: DataFrame, as_of
) -> DataFrame:
    """Live counts against the newest snapshot, with tolerances."""
    live = customers.agg(F.count(F.lit(1)).alias("live")).select(
        F.lit("customers_total").alias("metric_key"), "live"
    ).unionByName(
        acquired.filter(F.col("acquired_at") >= midnight(as_of))
        .agg(F.count(F.lit(1)).alias("live"))
        .select(F.lit("customers_acquired_today").alias("metric_key"), "live")
    )
    snapshot = latest_metrics(metrics).select("metric_key", F.col("metric_value").alias("snapshot"))
    allowed = F.when(
        F.col("metric_key") == "customers_total",
        F.greatest(F.lit(5), F.floor(F.col("live") * F.lit(0.0001))),
    ).otherwise(F.lit(1))
    gap = F.abs(F.col("live") - F.col("snapshot"))
    return live.join(snapshot, "metric_key").select(
        "metric_key", "live", "snapshot", gap.alias("diff"), (gap <= allowed).alias("ok")
    )


def freshness_grade(age: Column, ok_max: Column, stale_max: Column) -> Column:
    return (
        F.when(age.isNull(), F.lit("down"))
        .when(age <= ok_max, F.lit("ok"))
        .when(age <= stale_max, F.lit("stale"))
        .otherwise(F.lit("down"))
    )


def freshness(
    feeds: dict[str, tuple[DataFrame, str]], as_of, thresholds: Sequence[tuple[str, int, int]] = tuple(FRESHNESS)
) -> DataFrame:
    """Grade per service from the newest time in its table; a service without rows is down."""
    spark = next(iter(feeds.values()))[0].sparkSession
    newest = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.max(F.col(c).cast("timestamp")).alias("last_seen")).select(
                F.lit(service).alias("service"), "last_seen"
            )
            for service, (df, c) in feeds.items()
        ],
    )
    limits = spark.createDataFrame(list(thresholds), "service string, ok_max long, stale_max long")
    age = age_seconds(F.col("last_seen"), as_of)
    return newest.join(limits, "service").select(
        "service", "last_seen", age.alias("age_sec"),
        freshness_grade(age, F.col("ok_max"), F.col("stale_max")).alias("status"),
    )


def throughput(txns: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    return one_row(
        # Both counts lie within the day or the last minutes, so older partitions are pruned.
        txns.filter(F.col("ingested_at") >= F.least(midnight(as_of), minutes_before(as_of, 5))).agg(
            F.count_if(F.col("ingested_at") >= midnight(as_of)).alias("txns_today"),
            F.count_if(F.col("ingested_at") >= minutes_before(as_of, 5)).alias("txns_5m"),
        ),
        flags.filter(F.col("flagged_at") >= hours_before(as_of, 24)).agg(F.count(F.lit(1)).alias("alerts_24h")),
    )


def job_health(runs: DataFrame, as_of) -> DataFrame:
    """Per job: last start and state, runs and failures of 24 hours, last success."""
    recent = F.col("start_date") >= hours_before(as_of, 24)
    return runs.groupBy("dag_id").agg(
        F.max("start_date").alias("last_start"),
        F.max_by("state", F.struct("start_date", "run_id")).alias("last_state"),
        F.count_if(recent).alias("runs_24h"),
        F.count_if(recent & (F.col("state") == "failed")).alias("failed_24h"),
        F.max(F.when(F.col("state") == "success", F.col("start_date"))).alias("last_success"),
    )


def retention_cutoff(value: int, unit: str, as_of) -> Column:
    if unit not in ("days", "hours"):
        raise ValueError(f"unknown retention unit {unit!r}")
    return as_col(as_of) - F.expr(f"INTERVAL {int(value)} {unit.upper()}")


def apply_retention(df: DataFrame, column: str, value: int, unit: str, as_of) -> DataFrame:
    """Rows to keep; a row without a time is kept, as a delete by age would leave it."""
    return df.filter(F.coalesce(F.col(column) >= retention_cutoff(value, unit, as_of), F.lit(True)))


def retention_counts(
    tables: dict[str, DataFrame], as_of, policies: Sequence[tuple] = tuple(RETENTION)
) -> DataFrame:
    """Kept and deleted rows per policy."""
    parts = []
    for name, _label, column, value, unit in policies:
        if name in tables:
            old = F.coalesce(F.col(column) < retention_cutoff(value, unit, as_of), F.lit(False))
            parts.append(
                tables[name]
                .agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))
                .select(F.lit(name).alias("table_name"), "kept", "deleted")
            )
    return reduce(DataFrame.unionByName, parts)


def row_cap(df: DataFrame, n: int = METRICS_ROW_CAP, order: Sequence[Column] = ()) -> DataFrame:
    """The ``n`` first rows in ``order`` (newest first); the rest is what the cap deletes."""
    return page(df, list(order), n)


def retention_report(tables: dict[str, DataFrame], policies: Sequence[tuple] = tuple(RETENTION)) -> DataFrame:
    """Policy and row count per retained table."""
    parts = [
        tables[name]
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(name).alias("table_name"), F.lit(label).alias("label"),
            F.lit(f"{value} {unit}").alias("retention"), "row_count",
        )
        for name, label, _column, value, unit in policies
        if name in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def log_summary(log: DataFrame, as_of) -> DataFrame:
    recent = log.filter(F.col("ts") >= hours_before(as_of, 24))
    return recent.agg(
        F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("err_24h"),
        F.count_if(F.col("level") == "WARNING").alias("warn_24h"),
        F.count(F.lit(1)).alias("total_24h"),
    )


def log_by_source(log: DataFrame, as_of) -> DataFrame:
    return (
        log.filter(F.col("ts") >= hours_before(as_of, 24))
        .groupBy("source", "level")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "source", "level")
    )


def log_sources(log: DataFrame) -> DataFrame:
    return log.select("source").distinct().orderBy("source")


def log_search(
    log: DataFrame,
    as_of,
    levels: Sequence[str] = (),
    sources: Sequence[str] = (),
    since_hours: int | None = 24,
    search: str | None = None,
    limit: int = 500,
) -> DataFrame:
    """Newest log rows that pass the given filters."""
    df = log
    if since_hours:
        df = df.filter(F.col("ts") >= hours_before(as_of, since_hours))
    if levels:
        df = df.filter(F.col("level").isin(*levels))
    if sources:
        df = df.filter(F.col("source").isin(*sources))
    if search:
        df = df.filter(F.col("message").ilike(f"%{search}%") | F.col("logger").ilike(f"%{search}%"))
    return page(df, [F.desc("ts"), F.asc("id")], limit)


def log_histogram(log: DataFrame, as_of=None, since_hours: int | None = None) -> DataFrame:
    """Log rows per hour and level."""
    df = log if since_hours is None else log.filter(F.col("ts") >= hours_before(as_of, since_hours))
    return (
        df.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "level")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy("bucket", "level")
    )
