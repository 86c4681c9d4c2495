"""Alert priority, budget, archive, queue and dispositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.config import (
    BACKFILL_SEVERITY,
    GLOBAL_ALERT_CAP,
    OTHER_SEVERITY,
    RULE_ALERT_CAP,
    RULE_SEVERITY,
)
from tidewarden.functions.calendar import as_col, days_before, hours_before
from tidewarden.operators.enrich import by_party
from tidewarden.operators.heavy import salted_join
from tidewarden.sources.sinks import upsert

ALERT_KEY = ["txn_id", "rule_name"]

def flag_counts_24h(flags: DataFrame, as_of) -> DataFrame:
    """Alerts of the last 24 hours per rule, and in total in the row named ``total``."""
    return (
        flags.filter(F.col("flagged_at") >= hours_before(as_of, 24))
        .rollup("rule_name")
        .agg(F.count(F.lit(1)).alias("alert_count"))
        .select(F.coalesce("rule_name", F.lit("total")).alias("rule_name"), "alert_count")
    )


def _severity(table: dict[str, int]) -> Column:
    points = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(F.try_element_at(points, F.col("rule_name")), F.lit(OTHER_SEVERITY))


def alert_priority(flags: DataFrame, customers: DataFrame, severity: dict[str, int] = RULE_SEVERITY) -> DataFrame:
    """60 % rule severity plus amount bonus, 40 % customer risk, in decimal arithmetic."""
    risk = customers.select("customer_id", "risk_score")
    eur = F.coalesce("amount_eur", "amount", F.lit(0)).cast("decimal(18,2)")
    bonus = F.least(eur / F.lit(500).cast("decimal(4,0)"), F.lit(10).cast("decimal(4,0)"))
    signal = F.least(_severity(severity).cast("decimal(6,0)") + bonus, F.lit(100).cast("decimal(4,0)"))
    blend = F.lit(0.6).cast("decimal(2,1)") * signal.cast("decimal(12,6)") + F.lit(0.4).cast(
        "decimal(2,1)"
    ) * F.coalesce(F.col("risk_score"), F.lit(0)).cast("decimal(5,2)")
    return (
        flags.join(risk, "customer_id", "left")
        .withColumn("alert_priority_score", F.round(blend, 2).cast("decimal(5,2)"))
        .drop("risk_score")
    )


def backfill_priority(flags: DataFrame, customers: DataFrame) -> DataFrame:
    """Priorities as an older backfill set them: dormant and mule alerts get the plain severity."""
    return alert_priority(flags, customers, BACKFILL_SEVERITY)


def apply_budget(
    new: DataFrame,
    counts: DataFrame,
    global_cap: int = GLOBAL_ALERT_CAP,
    rule_cap: int = RULE_ALERT_CAP,
) -> DataFrame:
    """Alerts that fit the daily budget.

    ``counts`` (rule_name, alert_count) are the alerts already raised in 24 hours. Rules are served by
    headroom; each takes its cap off the global budget even if it has fewer alerts. Within a rule the
    highest priority, then the newest, then the lowest transaction id goes first.
    """
    present = new.select("rule_name").distinct().withColumn("present", F.lit(True))
    # One row per rule name: a handful of rows, whatever the number of alerts.
    rules = counts.join(present, "rule_name", "full_outer").select(
        "rule_name",
        F.coalesce("alert_count", F.lit(0)).alias("used"),
        F.coalesce("present", F.lit(False)).alias("present"),
    )
    everything = Window.partitionBy(F.lit(1))
    room = F.greatest(F.lit(rule_cap) - F.col("used"), F.lit(0))
    rules = rules.select(
        "rule_name",
        F.when(F.col("present"), room).otherwise(F.lit(0)).alias("headroom"),
        F.greatest(F.lit(global_cap) - F.sum("used").over(everything), F.lit(0)).alias("budget"),
    ).filter("headroom > 0")
    served = Window.partitionBy(F.lit(1)).orderBy(F.desc("headroom"), "rule_name")
    before = F.coalesce(
        F.sum("headroom").over(served.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    caps = rules.select(
        "rule_name", F.least(F.col("headroom"), F.col("budget") - before).alias("cap")
    ).filter("cap > 0")
    best = Window.partitionBy("rule_name").orderBy(
        F.desc_nulls_last("alert_priority_score"), F.desc("ts"), "txn_id"
    )
    # The literal bound lets Spark keep the best rows per task before the shuffle.
    ranked = new.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= rule_cap)
    return ranked.join(caps, "rule_name").filter("_rn <= cap").drop("_rn", "cap").select(*new.columns)


def archive(alerts: DataFrame, txns: DataFrame, as_of, heavy: Sequence = ()) -> DataFrame:
    """Every transaction of each alerted customer, one row per alert and transaction.

    Party rows of customers without an alert are dropped before the shuffle-heavy steps, and the OR
    condition on sender / receiver becomes an equi join. The payments of ``heavy`` parties are dealt to several tasks.
    """
    raised = alerts.filter(F.col("customer_id").isNotNull()).select(
        F.col("txn_id").alias("alert_txn_id"), "rule_name", "flagged_at", "customer_id"
    )
    alerted = raised.select(F.col("customer_id").alias("party_id")).distinct()
    sided = (
        by_party(txns)
        .join(alerted, "party_id", "left_semi")
        .dropDuplicates(["party_id", "txn_id"])
        .withColumnRenamed("ingested_at", "txn_ingested_at")
    )
    at = as_col(as_of)
    return (
        salted_join(sided, raised, "party_id", "customer_id", heavy)
        .drop("party_id")
        .withColumn("txn_ingested_at", F.coalesce("txn_ingested_at", at))
        .withColumn("archived_at", at)
    )


def archive_for(archived: DataFrame, alert_txn_id: str, rule_name: str, customer_id: str | None = None) -> DataFrame:
    hit = (F.col("alert_txn_id") == alert_txn_id) & (F.col("rule_name") == rule_name)
    if customer_id is not None:
        hit = hit & (F.col("customer_id") == customer_id)
    return archived.filter(hit).orderBy(F.desc("ts"), "txn_id")


def archive_counts(archived: DataFrame) -> DataFrame:
    """Archived transactions per alert, with the first archive time."""
    return archived.groupBy("alert_txn_id", "rule_name", "customer_id").agg(
        F.count(F.lit(1)).alias("archived_txns"), F.min("archived_at").alias("first_archived")
    )


def undecided(flags: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Alerts without a disposition."""
    return flags.join(dispositions.select(*ALERT_KEY), ALERT_KEY, "left_anti")


def _with_customer(alerts: DataFrame, customers: DataFrame) -> DataFrame:
    named = customers.select(
        "customer_id", F.col("name").alias("customer_name"), F.col("risk_score").alias("kyc_risk_score")
    )
    return attach(alerts, named, "customer_id").select(
        F.col("txn_id").alias("alert_id"), "customer_id", "rule_name", "flagged_at",
        "alert_priority_score", "customer_name", "kyc_risk_score",
    )


def by_priority() -> list[Column]:
    return [F.desc_nulls_last("alert_priority_score"), F.desc("flagged_at"), F.asc("txn_id"), F.asc("rule_name")]


def by_newest() -> list[Column]:
    return [F.desc("flagged_at"), F.asc("txn_id"), F.asc("rule_name")]


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """One page in a total order; each task keeps only its best ``offset + limit`` rows."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def attach(paged: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of a page to a table of any size.

    A left join cannot broadcast its left side, so the table is first reduced to the page's keys by a semi
    join, whose small side the page is; only the rows left are shuffled.
    """
    return paged.join(table.join(paged.select(key), key, "left_semi"), key, "left")


def open_alerts(
    flags: DataFrame, dispositions: DataFrame, customers: DataFrame, limit: int = 10, offset: int = 0
) -> DataFrame:
    """A page of the open queue by priority; customers are joined to the page only."""
    return _with_customer(page(undecided(flags, dispositions), by_priority(), limit, offset), customers)


def newest_open_alerts(flags: DataFrame, dispositions: DataFrame, customers: DataFrame, limit: int = 5) -> DataFrame:
    return _with_customer(page(undecided(flags, dispositions), by_newest(), limit), customers)


_DETAIL = [
    "txn_category", "txn_type", "country_code", "sender_customer_no", "receiver_customer_no",
    "sender_name", "receiver_name", "sender_identity_no", "receiver_identity_no",
    "sender_branch", "receiver_branch", "sender_country", "receiver_country", "txn_description",
]


def recent_alerts(flags: DataFrame, dispositions: DataFrame, txns: DataFrame, limit: int = 100) -> DataFrame:
    """Newest open alerts with the fields of their transaction."""
    newest = page(undecided(flags, dispositions), by_newest(), limit).select(
        *ALERT_KEY, "customer_id", "account_id", "amount", "amount_eur", "currency", "rule_detail",
        "window_type", "flagged_at",
    )
    return attach(newest, txns.select("txn_id", *_DETAIL), "txn_id")


def record_disposition(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Store decisions; the last one on an alert wins and refreshes its time."""
    return upsert(existing, new, ALERT_KEY, [F.desc("created_at"), F.asc("disposition")])


def archived_alerts(
    flags: DataFrame, dispositions: DataFrame, customers: DataFrame, limit: int | None = 10, offset: int = 0
) -> DataFrame:
    """Decided alerts with their outcome, newest decision first."""
    outcome = (
        F.when(F.col("disposition") == "sar_filed", "SAR filed")
        .when(F.col("disposition") == "false_positive", "White flag")
        .otherwise(F.col("disposition"))
    )
    decided = dispositions.join(flags.select(*ALERT_KEY, "customer_id", "flagged_at"), ALERT_KEY)
    paged = page(decided, [F.desc("created_at"), F.asc("txn_id"), F.asc("rule_name")], limit, offset)
    named = customers.select("customer_id", F.col("name").alias("customer_name"))
    return attach(paged, named, "customer_id").select(
        F.col("txn_id").alias("alert_id"), "rule_name", "disposition", outcome.alias("outcome"),
        "analyst_notes", F.col("created_at").alias("archived_at"), "customer_name", "flagged_at",
    )


def alert_counts(flags: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Open and decided alerts in one row."""
    decided = dispositions.select(*ALERT_KEY, F.lit(True).alias("decided"))
    state = flags.join(decided, ALERT_KEY, "left")
    return state.agg(
        F.count_if(F.col("decided").isNull()).alias("open_alerts"),
        F.count_if(F.col("decided").isNotNull()).alias("dispositioned"),
    )


def disposition_counts(dispositions: DataFrame) -> DataFrame:
    return dispositions.groupBy("disposition").agg(F.count(F.lit(1)).alias("cnt"))


def customer_open_alerts(
    flags: DataFrame, dispositions: DataFrame, customers: DataFrame, customer_id: str
) -> DataFrame:
    mine = flags.filter(F.col("customer_id") == customer_id)
    return _with_customer(undecided(mine, dispositions), customers).orderBy(
        F.desc_nulls_last("alert_priority_score"), F.desc("flagged_at"), "alert_id", "rule_name"
    )


def customer_alerts_30d(flags: DataFrame, customer_id: str, as_of) -> DataFrame:
    return (
        flags.filter((F.col("customer_id") == customer_id) & (F.col("flagged_at") >= days_before(as_of, 30)))
        .select("txn_id", "rule_name", "rule_detail", "window_type", "flagged_at")
        .orderBy(*by_newest())
    )


def alert_by_txn(flags: DataFrame, txns: DataFrame, txn_id: str, rule_name: str | None = None) -> DataFrame:
    """One alert with its transaction; without a rule the first rule by name."""
    hit = flags.filter(F.col("txn_id") == txn_id)
    if rule_name is not None:
        hit = hit.filter(F.col("rule_name") == rule_name)
    fields = [
        "txn_category", "txn_type", "country_code", "receiver_id", "sender_name", "receiver_name",
        "sender_country", "receiver_country", "txn_description",
    ]
    detail = txns.filter(F.col("txn_id") == txn_id).select("txn_id", *fields)
    return hit.orderBy("rule_name").limit(1).join(detail, "txn_id", "left")


def alert_disposition(dispositions: DataFrame, txn_id: str, rule_name: str) -> DataFrame:
    hit = (F.col("txn_id") == txn_id) & (F.col("rule_name") == rule_name)
    return dispositions.filter(hit).select("disposition", "analyst_notes", "created_at").limit(1)
