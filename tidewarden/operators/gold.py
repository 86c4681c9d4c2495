"""Gold marts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.calendar import days_before


def stg_flagged(flags: DataFrame) -> DataFrame:
    return flags.select(
        "txn_id", "account_id", "amount", "currency", "ts", "merchant", "rule_name", "rule_detail", "flagged_at"
    )


def gold_daily_fraud_summary(staged: DataFrame) -> DataFrame:
    """Alerts per day and rule. Accounts are grouped before they are counted."""
    per_account = staged.groupBy(
        F.to_date("flagged_at").alias("report_date"), "rule_name", "account_id"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return per_account.groupBy("report_date", "rule_name").agg(
        F.sum("n").alias("flag_count"),
        F.count("account_id").alias("distinct_accounts"),
        F.sum("total").alias("total_flagged_amount"),
    )


def gold_account_risk_score(staged: DataFrame) -> DataFrame:
    per_rule = staged.groupBy("account_id", "rule_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("amount").alias("amount"), F.max("flagged_at").alias("last")
    )
    scored = per_rule.groupBy("account_id").agg(
        F.sum("n").alias("total_flags"),
        F.count("rule_name").alias("distinct_rules"),
        F.max("amount").alias("max_flagged_amount"),
        F.max("last").alias("last_flagged_at"),
    )
    tier = F.when(F.col("total_flags") >= 5, "high").when(F.col("total_flags") >= 2, "medium").otherwise("low")
    return scored.withColumn("risk_tier", tier)


def _profile(txns: DataFrame, customers: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    since = days_before(as_of, 30)
    paid = (
        txns.filter((F.col("ts") >= since) & F.col("sender_id").isNotNull())
        .groupBy("sender_id", "receiver_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("volume"), F.max("amount").alias("top"))
        .groupBy(F.col("sender_id").alias("customer_id"))
        .agg(
            F.sum("n").alias("txn_count_30d"),
            F.sum("volume").alias("volume_30d"),
            F.count("receiver_id").alias("distinct_receivers_30d"),
            F.max("top").alias("max_txn_30d"),
        )
    )
    raised = flags.filter(F.col("flagged_at") >= since).groupBy("customer_id").agg(F.count(F.lit(1)).alias("raised"))
    who = customers.select("customer_id", "name", "segment", "risk_score", "is_pep")
    return who.join(paid, "customer_id").join(raised, "customer_id", "left")


_PROFILE = [
    "customer_id", "name", "segment", "risk_score", "is_pep", "txn_count_30d", "volume_30d",
    "distinct_receivers_30d", "max_txn_30d", "flag_count_30d",
]


def gold_customer_risk_profile(txns: DataFrame, customers: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    """30-day profile in which payments multiply with the customer's alerts.

    The mart is defined as a join of payments with alerts on the customer, so count, volume and alert
    count carry the product. The product is taken on the two aggregates; the joined rows, quadratic for a
    busy customer, are never made.
    """
    copies = F.coalesce(F.col("raised"), F.lit(1))
    return (
        _profile(txns, customers, flags, as_of)
        .withColumn("flag_count_30d", F.col("txn_count_30d") * F.coalesce("raised", F.lit(0)))
        .withColumn("volume_30d", F.col("volume_30d") * copies)
        .withColumn("txn_count_30d", F.col("txn_count_30d") * copies)
        .select(*_PROFILE)
    )


def gold_customer_risk_profile_dedup(txns: DataFrame, customers: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    """The same profile with every payment and every alert counted once."""
    return (
        _profile(txns, customers, flags, as_of)
        .withColumn("flag_count_30d", F.coalesce("raised", F.lit(0)))
        .select(*_PROFILE)
    )


def build_gold(
    txns: DataFrame, customers: DataFrame, flags: DataFrame, as_of, write: Callable[[str, DataFrame], DataFrame]
) -> dict[str, DataFrame]:
    """Staging, then the marts. ``write`` stores a table and returns it as stored."""
    staged = stg_flagged(flags)
    marts = {
        "gold_daily_fraud_summary": gold_daily_fraud_summary(staged),
        "gold_account_risk_score": gold_account_risk_score(staged),
        "gold_customer_risk_profile": gold_customer_risk_profile(txns, customers, flags, as_of),
    }
    return {"stg_flagged": staged, **{name: write(name, df) for name, df in marts.items()}}
