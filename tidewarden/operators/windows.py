"""Window metrics and behaviour profiles per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.calendar import (
    WINDOW_TYPES,
    as_col,
    code_start,
    code_type,
    days_before,
    window_codes,
    window_start,
)
from tidewarden.functions.money import money

# Columns of the stored metrics.
METRIC_COLUMNS = [
    "customer_id", "window_type", "total_volume", "txn_count",
    "distinct_receiver_count", "window_start", "computed_at",
]


def transfer_facts(txns: DataFrame) -> DataFrame:
    """Distinct (sender, receiver, EUR amount, event time) facts.

    The distinct shuffles on all four columns, so a hot sender or a hot pair is spread evenly.
    """
    return (
        txns.select(
            F.coalesce("sender_customer_no", "sender_id").alias("sender_id"),
            F.coalesce("receiver_customer_no", "receiver_id").alias("receiver_id"),
            money(F.col("amount_eur")).alias("amount_eur"),
            F.col("ts").alias("event_ts"),
        )
        .filter(F.col("sender_id").isNotNull())
        .distinct()
    )


def daily_facts(txns: DataFrame) -> DataFrame:
    """Volume and count per sender, receiver and calendar day.

    All four window types are made of whole days, so these partial sums can be stored per day and every
    window rolled up from them without a second look at the payments.
    """
    return (
        transfer_facts(txns)
        .groupBy("sender_id", "receiver_id", F.date_trunc("day", "event_ts").alias("day"))
        .agg(F.sum("amount_eur").alias("volume"), F.count(F.lit(1)).alias("n"))
    )


def _metric_rows(grouped: DataFrame, computed_at) -> DataFrame:
    """Name the windows of (customer_id, code) groups."""
    return grouped.select(
        "customer_id",
        code_type(F.col("code")).alias("window_type"),
        money(F.col("total_volume")).alias("total_volume"),
        "txn_count",
        "distinct_receiver_count",
        code_start(F.col("code")).alias("window_start"),
        as_col(computed_at).alias("computed_at"),
    )


def window_metrics(txns: DataFrame, computed_at) -> DataFrame:
    """Metrics of every window instance that holds a payment of the sender.

    Spark counts the distinct receivers in two steps, grouped by receiver first, so a hot sender is
    spread over its receivers and no distinct list is built.
    """
    grouped = (
        transfer_facts(txns)
        .select("sender_id", "receiver_id", "amount_eur", F.explode(window_codes(F.col("event_ts"))).alias("code"))
        .groupBy(F.col("sender_id").alias("customer_id"), "code")
        .agg(
            F.sum("amount_eur").alias("total_volume"),
            F.count(F.lit(1)).alias("txn_count"),
            F.count_distinct("receiver_id").alias("distinct_receiver_count"),
        )
    )
    return _metric_rows(grouped, computed_at)


def roll_up(daily: DataFrame, computed_at) -> DataFrame:
    """The same metrics from stored daily sums, without a second look at the payments."""
    grouped = (
        daily.select("sender_id", "receiver_id", "volume", "n", F.explode(window_codes(F.col("day"))).alias("code"))
        .groupBy(F.col("sender_id").alias("customer_id"), "code")
        .agg(
            F.sum("volume").alias("total_volume"),
            F.sum("n").alias("txn_count"),
            F.count_distinct("receiver_id").alias("distinct_receiver_count"),
        )
    )
    return _metric_rows(grouped, computed_at)


def window_metrics_asof(txns: DataFrame, as_of) -> DataFrame:
    """Metrics of the four windows that are open at ``as_of``.

    One pass with conditional sums per (sender, receiver), then per sender; rows are never multiplied.
    The scan reaches back to the earliest open window and has no upper bound.
    """
    as_of = as_col(as_of)
    starts = {w: window_start(as_of, w) for w in WINDOW_TYPES}
    # The same 30 days of history as the profile, or more where a window opened earlier.
    horizon = F.least(days_before(as_of, 30), *starts.values())
    facts = transfer_facts(txns.filter(F.col("ts") >= horizon))

    def inside(w: str) -> Column:
        return F.col("event_ts") >= starts[w]

    pairs = facts.groupBy("sender_id", "receiver_id").agg(
        *[F.sum(F.when(inside(w), F.col("amount_eur"))).alias(f"{w}_volume") for w in WINDOW_TYPES],
        *[F.count_if(inside(w)).alias(f"{w}_n") for w in WINDOW_TYPES],
    )
    senders = pairs.groupBy("sender_id").agg(
        *[F.sum(f"{w}_volume").alias(f"{w}_volume") for w in WINDOW_TYPES],
        *[F.sum(f"{w}_n").alias(f"{w}_n") for w in WINDOW_TYPES],
        *[
            F.count_if((F.col(f"{w}_n") > 0) & F.col("receiver_id").isNotNull()).alias(f"{w}_receivers")
            for w in WINDOW_TYPES
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(w).alias("window_type"),
                money(F.col(f"{w}_volume")).alias("total_volume"),
                F.col(f"{w}_n").alias("txn_count"),
                F.col(f"{w}_receivers").alias("distinct_receiver_count"),
                starts[w].alias("window_start"),
            )
            for w in WINDOW_TYPES
        ]
    )
    return (
        senders.select(F.col("sender_id").alias("customer_id"), F.inline(rows))
        .filter("txn_count > 0")
        .withColumn("computed_at", as_of)
        .select(*METRIC_COLUMNS)
    )


def behavior_30d(txns: DataFrame, as_of) -> DataFrame:
    """Trailing 30-day profile per sender; the primary country is the earliest non-null one."""
    recent = txns.filter(F.col("ts") >= days_before(as_of, 30)).select(
        F.coalesce("sender_customer_no", "sender_id").alias("customer_id"),
        F.coalesce("receiver_customer_no", "receiver_id").alias("counterparty_id"),
        "txn_id",
        money(F.col("amount_eur")).alias("amount_eur"),
        "sender_country",
        "ts",
    )
    seen = F.struct("ts", "txn_id", "sender_country")
    per_counterparty = (
        recent.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "counterparty_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("amount_eur").alias("volume"),
            F.min(F.when(F.col("sender_country").isNotNull(), seen)).alias("first_seen"),
            F.max("ts").alias("last_at"),
        )
    )
    return per_counterparty.groupBy("customer_id").agg(
        F.sum("n").alias("txn_count_30d"),
        money(F.sum("volume")).alias("volume_30d"),
        F.count("counterparty_id").alias("distinct_counterparties_30d"),
        F.min("first_seen")["sender_country"].alias("primary_sender_country"),
        F.max("last_at").alias("last_txn_at"),
    ).withColumn("computed_at", as_col(as_of))


def spend_30d(txns: DataFrame, as_of) -> DataFrame:
    """Count, volume and mean amount per sender over 30 days."""
    return (
        txns.filter(F.col("ts") >= days_before(as_of, 30))
        .groupBy(F.coalesce("sender_customer_no", "sender_id").alias("customer_id"))
        .agg(
            F.count(F.lit(1)).alias("txn_count_30d"),
            F.coalesce(F.sum("amount_eur"), F.lit(0)).alias("volume_30d"),
            # A double quotient: ``avg`` of a decimal would be cut to six digits.
            F.coalesce(F.sum("amount_eur").cast("double") / F.count("amount_eur"), F.lit(0.0)).alias("avg_amount_30d"),
        )
        .filter(F.col("customer_id").isNotNull())
    )


def customer_flags_30d(flags: DataFrame, as_of) -> DataFrame:
    """Alerts per customer, rule and window type over 30 days, with the latest time."""
    return (
        flags.filter(F.col("flagged_at") >= days_before(as_of, 30))
        .groupBy("customer_id", "rule_name", "window_type")
        .agg(F.count(F.lit(1)).alias("cnt"), F.max("flagged_at").alias("last_flagged"))
    )


def latest_window_metrics(metrics: DataFrame) -> DataFrame:
    """Newest stored metrics per customer and window type: latest computed, then latest window."""
    newest = F.max_by(
        F.struct("total_volume", "txn_count", "distinct_receiver_count", "window_start", "computed_at"),
        F.struct("computed_at", "window_start"),
    )
    return (
        metrics.groupBy("customer_id", "window_type")
        .agg(newest.alias("m"))
        .select("customer_id", "window_type", "m.*")
    )
