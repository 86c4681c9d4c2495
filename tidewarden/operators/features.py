"""Model features per active sender."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.calendar import days_before

# Model inputs, in model order. The alert count is the label and no input.
FEATURE_COLUMNS = [
    "txn_count_30d", "volume_30d", "avg_amount_30d", "max_txn_30d", "std_amount_30d",
    "distinct_receivers_30d", "distinct_countries_30d", "cross_border_txns", "cross_border_ratio",
    "fast_txns", "kyc_risk_score", "is_pep",
]
LOG_COLUMNS = ["volume_30d", "avg_amount_30d", "max_txn_30d", "std_amount_30d"]
HOME_COUNTRY = "DE"


def features(txns: DataFrame, customers: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    """30-day features per sender, with the alert count as label.

    Payments are summed per (sender, receiver, country) first; distinct counts and moments are taken from
    those sums. The deviation comes from exact decimal sums, so the grouping does not change it.
    """
    since = days_before(as_of, 30)
    abroad = F.col("receiver_country").isNotNull() & (F.col("receiver_country") != HOME_COUNTRY)
    grouped = (
        txns.filter(F.col("ts") >= since)
        .select(
            F.coalesce("sender_customer_no", "sender_id").alias("customer_id"),
            "amount_eur", "receiver_country", "receiver_customer_no", "txn_type",
        )
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "receiver_customer_no", "receiver_country")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("amount_eur").alias("amounts"),
            F.sum("amount_eur").alias("total"),
            F.sum((F.col("amount_eur") * F.col("amount_eur")).cast("decimal(28,4)")).alias("squares"),
            F.max("amount_eur").alias("top"),
            F.count_if(abroad).alias("abroad"),
            F.count_if(F.col("txn_type") == "FAST").alias("fast"),
        )
    )
    sums = grouped.groupBy("customer_id").agg(
        F.sum("n").alias("txn_count_30d"),
        F.sum("amounts").alias("amounts"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(24,2)").alias("total"),
        F.coalesce(F.sum("squares"), F.lit(0)).cast("decimal(38,4)").alias("squares"),
        F.coalesce(F.max("top"), F.lit(0)).cast("double").alias("max_txn_30d"),
        F.count_distinct("receiver_customer_no").alias("distinct_receivers_30d"),
        F.count_distinct("receiver_country").alias("distinct_countries_30d"),
        F.sum("abroad").alias("cross_border_txns"),
        F.sum("fast").alias("fast_txns"),
    )
    n = F.col("amounts")
    spread = (F.col("squares") * n).cast("double") - (F.col("total") * F.col("total")).cast("double")
    agg = sums.select(
        "customer_id",
        "txn_count_30d",
        F.col("total").cast("double").alias("volume_30d"),
        F.when(n > 0, F.col("total").cast("double") / n).otherwise(0.0).alias("avg_amount_30d"),
        "max_txn_30d",
        F.when(n > 0, F.sqrt(F.greatest(spread, F.lit(0.0))) / n).otherwise(0.0).alias("std_amount_30d"),
        "distinct_receivers_30d",
        "distinct_countries_30d",
        "cross_border_txns",
        (F.col("cross_border_txns") / F.col("txn_count_30d")).alias("cross_border_ratio"),
        "fast_txns",
    )
    raised = (
        flags.filter((F.col("flagged_at") >= since) & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("flag_count_30d"))
    )
    return (
        agg.join(customers.select("customer_id", "risk_score", "is_pep"), "customer_id", "left")
        .join(raised, "customer_id", "left")
        .select(
            *agg.columns,
            F.coalesce("risk_score", F.lit(0)).cast("double").alias("kyc_risk_score"),
            F.when(F.col("is_pep"), 1).otherwise(0).alias("is_pep"),
            F.coalesce("flag_count_30d", F.lit(0)).alias("flag_count_30d"),
            (F.coalesce("flag_count_30d", F.lit(0)) > 0).alias("rule_flagged"),
        )
    )


def feature_matrix(df: DataFrame) -> DataFrame:
    """Model inputs as doubles: log on the money columns, zero for gaps; other columns are kept."""

    def model_input(name: str):
        value = F.col(name).cast("double")
        if name in LOG_COLUMNS:
            value = F.log1p(F.greatest(value, F.lit(0.0)))
        return F.coalesce(value, F.lit(0.0))

    rest = [c for c in df.columns if c not in FEATURE_COLUMNS]
    return df.select(*rest, *[model_input(c).alias(c) for c in FEATURE_COLUMNS])


def assemble(df: DataFrame, output: str = "features") -> DataFrame:
    """The feature matrix as one vector column."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol=output).transform(feature_matrix(df))
