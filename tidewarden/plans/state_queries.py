"""Queries over streams that keep state and over versioned tables, and the same as SQL.

``QUERIES`` and ``BODY`` are merged into the registry and the SQL twin; a ``BODY`` uses the twin's shared steps.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators import (
    alerts,
    analytics,
    enrich,
    features,
    heavy,
    iforest,
    scoring,
    selection,
    sessions,
    sketches,
    triage,
    windows,
)
from tidewarden.plans.workspace import Workspace
from tidewarden.session import cut_lineage, scratch_path
from tidewarden.sources import binding, layout, sinks
from tidewarden.sources import tables as source_tables
from tidewarden.sources.keyed import KeyedTable
from tidewarden.sources.versions import VersionedTable
from tidewarden.streaming import kept, lifecycle
from tidewarden.streaming import source as streams

#: Events are sparse; a pause of six hours ends a session here.
GAP = "6 hours"
ONE_CUSTOMER = "CUST-0000012"
METRIC_KEYS = ["customer_id", "window_type", "window_start"]


def _delivered(w: Workspace, run: Callable[[DataFrame, str], DataFrame], name: str, twice: bool = False) -> DataFrame:
    """Run a stream over two deliveries: six payments of seven, then the others, which come late.

    With ``twice`` the second delivery repeats the first.
    """
    folder, base = scratch_path(w.spark, f"{name}-in"), scratch_path(w.spark, name)
    seventh = F.col("event_id") % 7 == 0
    for delivery in (w.events.filter(~seventh), w.events if twice else w.events.filter(seventh)):
        delivery.write.mode("append").parquet(folder)
        result = run(streams.payment_stream(w.spark, folder), base)
    return result


def _stream_sessions(w: Workspace) -> DataFrame:
    found = _delivered(w, lambda payments, base: kept.run_sessions(payments, base, GAP), "stream-sessions")
    return sessions.bursts(found, gap=GAP)


def _stream_velocity_late(w: Workspace) -> DataFrame:
    cfg = {**w.cfg, "velocity": {**w.cfg["velocity"], "max_txns_per_account": 1}}
    return _delivered(w, lambda payments, base: kept.run_velocity(payments, base, cfg), "stream-velocity-late")


def _stream_dedupe_late(w: Workspace) -> DataFrame:
    found = _delivered(w, kept.run_once, "stream-dedupe-late", twice=True)
    return found.select("txn_id", "ts", "late")


def _stream_episodes(w: Workspace) -> DataFrame:
    """The stored alerts and their decisions as one stream of events."""
    owners = w.flags.select("txn_id", "rule_name", "customer_id")
    decided = w.dispositions.join(owners, ["txn_id", "rule_name"])
    folder = scratch_path(w.spark, "alert-events")
    lifecycle.alert_events(w.flags).unionByName(lifecycle.decision_events(decided)).write.parquet(folder)
    events = w.spark.readStream.schema(w.spark.read.parquet(folder).schema).parquet(folder)
    found = lifecycle.run_episodes(events, scratch_path(w.spark, "stream-episodes"), memory_days=3650)
    return found.drop("batch_id")


def _two_states(w: Workspace) -> tuple[DataFrame, DataFrame]:
    """Stored metrics, and those of the last two weeks computed again with new payments."""
    old = windows.window_metrics(w.txns.filter(F.col("ts") < "2024-01-20"), "2024-01-20 00:00:00")
    return old, windows.window_metrics(w.txns.filter(F.col("ts") >= "2024-01-15"), w.as_of)


def _keyed_table(w: Workspace) -> DataFrame:
    """The keyed upsert as two versions of a bucketed table."""
    table = KeyedTable(w.spark, scratch_path(w.spark, "keyed-metrics"), METRIC_KEYS)
    for batch, state in enumerate(_two_states(w)):
        table.upsert(state, [F.desc("computed_at")], batch)
    return table.read()


def _keyed_lookup(w: Workspace) -> DataFrame:
    """Addresses of a few customers by key, and what is left after deleting some."""
    table = KeyedTable(w.spark, scratch_path(w.spark, "keyed-customers"), ["customer_id"])
    table.insert_new(w.customers.select("customer_id", "name", "segment"))
    table.delete(w.customers.filter(F.col("customer_id").endswith("7")))
    return table.lookup(w.customers.filter("segment = 'premium'").select("customer_id"))


def _snapshot_versions(w: Workspace) -> DataFrame:
    """Alerts per rule in two published states of one table, each read as its own version."""
    table = VersionedTable(w.spark, scratch_path(w.spark, "snapshot"))
    for until in ("2024-01-15", "2024-02-01"):
        table.publish(w.flags.filter(F.col("flagged_at") < until).groupBy("rule_name").agg(F.count(F.lit(1)).alias("alerts")))
    return table.read(1).withColumn("version", F.lit(1)).unionByName(table.read().withColumn("version", F.lit(table.current().number)))


def _large_cap(w: Workspace) -> DataFrame:
    """The newest 700 metrics by selection of the last row instead of a sort."""
    order = [("computed_at", True), ("window_start", True), ("customer_id", False), ("window_type", False)]
    found = selection.first_rows(w.metrics, 700, order, page_rows=0)
    return found.select("customer_id", "window_type", "window_start", "txn_count")


def _largest_payments(w: Workspace) -> DataFrame:
    """The 500 largest payments; amounts tie, and the id decides."""
    found = selection.first_rows(w.txns, 500, [("amount_eur", True), ("txn_id", False)], page_rows=0)
    return found.select("txn_id", "amount_eur")


def _archive_heavy(w: Workspace) -> DataFrame:
    """The archive with the payments of heavy parties dealt to several tasks."""
    parties = enrich.by_party(w.txns).select("party_id")
    archived = alerts.archive(w.budgeted, w.txns, w.as_of, heavy.heavy_keys(parties, "party_id"))
    return archived.select(
        "alert_txn_id", "rule_name", "customer_id", "flagged_at", "archived_at", "txn_id", "sender_customer_no", "receiver_customer_no",
        "amount_eur", "ts", "txn_ingested_at",
    )


def _party_join_heavy(w: Workspace) -> DataFrame:
    alerted = w.flags.filter(F.col("rule_name") == "high_value").select("customer_id").distinct()
    sides = w.txns.select("txn_id", "sender_customer_no", "receiver_customer_no", "amount_eur")
    keys = heavy.heavy_keys(enrich.by_party(sides), "party_id")
    return enrich.party_join(alerted, sides, keys).select("customer_id", "party_txn_id", "amount_eur")


def _receiver_sketches(w: Workspace) -> DataFrame:
    """Distinct receivers of the last seven days, exact, and whether the merged sketches agree within their error."""
    span = ("2024-01-24", "2024-01-30")
    estimate = sketches.receivers_between(sketches.daily_sketches(w.txns), *span).withColumnRenamed("receivers", "estimate")
    exact = sketches.exact_between(w.txns, *span)
    agrees = sketches.within_error(F.col("estimate"), F.col("receivers")).alias("agrees")
    return exact.join(estimate, "customer_id").select("customer_id", "receivers", agrees)


def _laid_history(w: Workspace) -> DataFrame:
    return layout.history(w.laid, w.as_of, 7).select("txn_id", "ts", "amount_eur")


def _laid_customer(w: Workspace) -> DataFrame:
    """A customer's payments of 30 days from the laid-out table."""
    recent = layout.of_customer(layout.history(w.laid, w.as_of), ONE_CUSTOMER)
    return analytics.customer_txns(recent, ONE_CUSTOMER, w.as_of, None)


def _all(condition: Column) -> Column:
    return F.coalesce(F.every(condition), F.lit(True))


def _sample_summary(w: Workspace) -> DataFrame:
    """What a random sample must be whatever it draws: its size, one status, no customer twice."""
    drawn = analytics.sample_customers(w.customers, "active", 50)
    return drawn.agg(
        F.count(F.lit(1)).alias("customers"), F.count_distinct("customer_id").alias("different"), _all(F.col("customer_status") == "active").alias("active")
    )


def _forest_summary(w: Workspace) -> DataFrame:
    """What the scores of any forest must be: one per customer, from 0 to 1, ranked without gaps, the same share flagged."""
    matrix = features.feature_matrix(w.feature_rows)
    scored = iforest.IsolationForest(trees=50).fit(matrix).score(matrix)
    ranked = scoring.normalize(scoring.flag_anomalies(cut_lineage(scored), "raw_score"), "raw_score")
    return ranked.agg(
        F.count(F.lit(1)).alias("customers"),
        F.min("anomaly_score").alias("least"),
        F.max("anomaly_score").alias("most"),
        F.count_distinct("anomaly_rank").alias("ranks"),
        F.max("anomaly_rank").alias("last_rank"),
        (F.count_if("is_anomaly") >= F.floor(F.count(F.lit(1)) * scoring.CONTAMINATION)).alias("enough_flagged"),
        _all((F.col("raw_score") > 0) & (F.col("raw_score") < 1)).alias("in_range"),
    )


def _fold_summary(w: Workspace) -> DataFrame:
    """Out-of-fold scores by fold and label: every customer once, each with a probability; none if labels are too few."""
    rows = cut_lineage(triage.training_rows(w.labelled))
    checked = triage.check_balance(rows)
    if checked.trained:
        scored = triage.oof(rows, checked.folds, iterations=5)
    else:
        scored = rows.limit(0).select("label", F.lit(0).alias("fold"), F.lit(0.0).alias("triage_score"))
    return scored.groupBy("fold", "label").agg(
        F.count(F.lit(1)).alias("customers"), _all(F.col("triage_score").between(0, 1)).alias("probabilities")
    )


def _importance_summary(w: Workspace) -> DataFrame:
    """Importances of any trees: one per feature, none negative, one in sum."""
    rows = cut_lineage(triage.training_rows(w.labelled))
    model = triage.triage_fit(rows, iterations=5).model
    found = w.spark.createDataFrame([], "feature string, importance double") if model is None else triage.importances(model, rows)
    return found.agg(
        F.count_distinct("feature").alias("features"), _all(F.col("importance") >= 0).alias("none_negative"), F.round(F.coalesce(F.sum("importance"), F.lit(0.0)), 3).alias("total")
    )


def _run_summary(w: Workspace) -> DataFrame:
    """The registry row of a run, without what depends on the trees."""
    rows = cut_lineage(triage.training_rows(w.labelled))
    result = triage.triage_fit(rows, iterations=5)
    evaluated = cut_lineage(triage.oof(rows, result.folds, iterations=5)) if result.trained else None
    record = triage.run_record(w.scores, evaluated, result, "v1", w.as_of)
    quality = [F.col(c).between(0, 1) for c in ("roc_auc", "pr_auc", "precision_score", "recall_score", "f1_score")]
    return record.select("model_version", "trained_at", "n_samples", "n_features", "n_anomalies", "supervised_trained", reduce(Column.__and__, quality).alias("in_range"))


def _read_back(w: Workspace) -> DataFrame:
    """Every sink writes the alerts of two spans one after the other, and is read again."""
    base = scratch_path(w.spark, "read-back")
    early = w.flags.filter(F.col("flagged_at") < "2024-01-15").select("txn_id", "rule_name", "ts")
    late = w.flags.filter(F.col("flagged_at") >= "2024-01-15").select("txn_id", "rule_name", "ts")
    for part in (early, late):
        sinks.append(part, f"{base}/append")
        sinks.overwrite(part, f"{base}/overwrite")
        sinks.overwrite_days(part, f"{base}/days")
        sinks.to_csv(part, f"{base}/csv")
        sinks.publish_snapshot(part, f"{base}/snapshot")
        sinks.append_run(part.agg(F.count(F.lit(1)).alias("n")), f"{base}/runs")
    sinks.overwrite_days(late, f"{base}/days")  # the same days again
    sinks.publish_gold(early, base, "gold", "1")
    sinks.publish_gold(late, base, "gold", "2")
    read = w.spark.read
    tables = {
        "append": read.parquet(f"{base}/append"),
        "overwrite": read.parquet(f"{base}/overwrite"),
        "overwrite_days": read.parquet(f"{base}/days"),
        "csv": read.option("header", True).csv(f"{base}/csv"),
        "snapshot": VersionedTable(w.spark, f"{base}/snapshot").read(),
        "snapshot_before": VersionedTable(w.spark, f"{base}/snapshot").read(1),
        "runs": read.parquet(f"{base}/runs"),
        "gold_runs": read.parquet(f"{base}/gold"),
        "gold_current": VersionedTable(w.spark, f"{base}/gold_current").read(),
    }
    return source_tables.table_counts(tables)


QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {
    "sample_summary": _sample_summary,
    "isolation_forest_summary": _forest_summary,
    "oof_summary": _fold_summary,
    "importances_summary": _importance_summary,
    "run_record_summary": _run_summary,
    "sinks_read_back": _read_back,
    "row_cap_large": _large_cap,
    "largest_payments": _largest_payments,
    "archive_heavy": _archive_heavy,
    "party_join_heavy": _party_join_heavy,
    "receiver_sketches": _receiver_sketches,
    "alert_grid": lambda w: analytics.alert_grid(w.flags, w.as_of),
    "history_laid": _laid_history,
    "customer_txns_laid": _laid_customer,
    "recent_sent_laid": lambda w: analytics.recent_sent(layout.sent_by(w.laid, ONE_CUSTOMER), ONE_CUSTOMER),
    "burst_sessions": lambda w: sessions.bursts(sessions.sessions(w.wire, GAP), gap=GAP),
    "burst_sessions_closed": lambda w: sessions.bursts(
        sessions.sessions(w.wire, GAP), closed_by=F.lit(binding.AS_OF).cast("timestamp"), gap=GAP
    ),
    "stream_burst_sessions": _stream_sessions,
    "stream_velocity_late": _stream_velocity_late,
    "stream_dedupe_late": _stream_dedupe_late,
    "stream_alert_episodes": _stream_episodes,
    "keyed_table": _keyed_table,
    "keyed_lookup": _keyed_lookup,
    "snapshot_versions": _snapshot_versions,
}


def bodies(as_of: str) -> dict[str, str]:
    """SQL of the queries over the twin's shared steps."""
    bursts = f"""
SELECT sender_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS txn_count, CAST(sum(amount_eur) AS DOUBLE) AS volume,
       CAST(max(amount_eur) AS DOUBLE) AS largest, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds
FROM (SELECT *, sum(fresh) OVER (PARTITION BY sender_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT sender_id, ts, amount_eur,
              CASE WHEN ts <= lag(ts) OVER (PARTITION BY sender_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
            FROM txn WHERE sender_id IS NOT NULL))
GROUP BY sender_id, island HAVING count(*) >= {sessions.BURST}"""
    trained = (
        "SELECT count(*) >= 40 AND count(*) FILTER (rule_flagged) >= 10 AND count(*) FILTER (NOT rule_flagged) >= 10 AS trained FROM labelled"
    )
    late = "(e % 7 = 0 AND ts < (SELECT max(ts) FROM txn WHERE e % 7 <> 0) - INTERVAL 2 DAY)"
    episodes = """
SELECT customer_id, rule_name, n_decided, min(ts) FILTER (d = 0) AS first_ts, max(ts) FILTER (d = 0) AS last_ts,
       count(*) FILTER (d = 0) AS alert_count, count(*) FILTER (d = 1) AS decisions, max(disposition) FILTER (d = 1) AS disposition
FROM (SELECT *, coalesce(sum(d) OVER (PARTITION BY customer_id, rule_name ORDER BY ts, d, disposition
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_decided
      FROM (SELECT customer_id, rule_name, flagged_at AS ts, 0 AS d, NULL AS disposition FROM flags
            UNION ALL SELECT f.customer_id, f.rule_name, p.created_at, 1, p.disposition
            FROM disp p JOIN flags f ON f.txn_id = p.txn_id AND f.rule_name = p.rule_name))
GROUP BY ALL HAVING count(*) FILTER (d = 0) > 0"""
    return {
        "burst_sessions": bursts,
        "burst_sessions_closed": f"{bursts} AND max(ts) + INTERVAL 6 HOUR < {as_of}",
        "stream_burst_sessions": bursts,
        "stream_velocity_late": (
            "SELECT sender_id AS account_id, time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS window_start, count(*) AS txn_count, "
            f"count(*) FILTER ({late}) AS late_count FROM txn, range(5) r(i) WHERE sender_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
        ),
        "stream_dedupe_late": f"SELECT txn_id, ts, {late} AS late FROM txn",
        "stream_alert_episodes": (
            f"SELECT customer_id, rule_name, 'opened' AS change, first_ts, first_ts AS last_ts, 1 AS alert_count, NULL AS disposition FROM ({episodes}) "
            f"UNION ALL SELECT customer_id, rule_name, 'decided', first_ts, last_ts, alert_count, disposition FROM ({episodes}) WHERE decisions > 0"
        ),
        "sample_summary": (
            "SELECT least(50, count(*)) AS customers, least(50, count(*)) AS different, TRUE AS active FROM cust WHERE customer_status = 'active'"
        ),
        "isolation_forest_summary": (
            "SELECT count(*) AS customers, 0.0 AS least, 1.0 AS most, count(*) AS ranks, count(*) AS last_rank, TRUE AS enough_flagged, TRUE AS in_range FROM feat"
        ),
        "oof_summary": f"""
SELECT fold, label, count(*) AS customers, TRUE AS probabilities FROM (
SELECT (row_number() OVER (ORDER BY rule_flagged, customer_id) - 1) % k AS fold, CAST(rule_flagged AS INTEGER) AS label
FROM labelled, (SELECT least(5, count(*) FILTER (rule_flagged), count(*) FILTER (NOT rule_flagged)) AS k FROM labelled)) WHERE (SELECT trained FROM ({trained})) GROUP BY 1, 2""",
        "importances_summary": f"SELECT CASE WHEN trained THEN 12 ELSE 0 END AS features, TRUE AS none_negative, CASE WHEN trained THEN 1.0 ELSE 0.0 END AS total FROM ({trained})",
        "run_record_summary": (
            f"SELECT 'v1' AS model_version, {as_of} AS trained_at, count(*) AS n_samples, 12 AS n_features, count(*) FILTER (is_anomaly) AS n_anomalies, "
            f"(SELECT trained FROM ({trained})) AS supervised_trained, (SELECT CASE WHEN trained THEN TRUE END FROM ({trained})) AS in_range FROM scores"
        ),
        "sinks_read_back": """
SELECT unnest(['append','overwrite','overwrite_days','csv','snapshot','snapshot_before','runs','gold_runs','gold_current']) AS table_name,
       unnest([a + b, b, a - again + b, b, b, a, 2, a + b, b]) AS row_count
FROM (SELECT count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b, count(*) FILTER (early AND ts >= first_late) AS again
      FROM (SELECT flagged_at < TIMESTAMP '2024-01-15' AS early, ts,
              (SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) FROM flags WHERE flagged_at >= TIMESTAMP '2024-01-15') AS first_late FROM flags))""",
        "row_cap_large": (
            "SELECT customer_id, window_type, window_start, txn_count FROM metrics ORDER BY computed_at DESC, window_start DESC, customer_id, window_type LIMIT 700"
        ),
        "largest_payments": "SELECT txn_id, CAST(txn.amount_eur AS DOUBLE) AS amount_eur FROM txn ORDER BY txn.amount_eur DESC, txn_id LIMIT 500",
        "receiver_sketches": (
            "SELECT sender_id AS customer_id, count(DISTINCT receiver_id) AS receivers, TRUE AS agrees FROM txn "
            "WHERE sender_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1"
        ),
        "alert_grid": f"""
SELECT rule_name, strftime(day, '%Y-%m-%d') AS day, n AS alerts,
       CAST(sum(n) OVER (PARTITION BY rule_name ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS alerts_7d
FROM (SELECT r.rule_name, d.day, count(f.txn_id) AS n
      FROM (SELECT DISTINCT rule_name FROM flags WHERE flagged_at >= CAST({as_of} AS DATE) - 29 AND flagged_at < CAST({as_of} AS DATE) + 1) r
      CROSS JOIN (SELECT CAST(CAST({as_of} AS DATE) - CAST(i AS INTEGER) AS DATE) AS day FROM range(30) t(i)) d
      LEFT JOIN flags f ON f.rule_name = r.rule_name AND CAST(f.flagged_at AS DATE) = d.day GROUP BY ALL)""",
        "keyed_lookup": "SELECT customer_id, name, segment FROM cust WHERE segment = 'premium' AND customer_id NOT LIKE '%7'",
        "snapshot_versions": (
            "SELECT rule_name, count(*) AS alerts, 1 AS version FROM flags WHERE flagged_at < TIMESTAMP '2024-01-15' GROUP BY 1 "
            "UNION ALL SELECT rule_name, count(*), 2 FROM flags WHERE flagged_at < TIMESTAMP '2024-02-01' GROUP BY 1"
        ),
    }
