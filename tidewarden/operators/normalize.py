"""Normalisation, defaults, projection and filters of payments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.config import COUNTRIES, FX_TO_EUR, ONBOARDING_CHANNELS
from tidewarden.functions import text
from tidewarden.functions.calendar import as_col, relative_age
from tidewarden.functions.money import in_eur, money

# Columns of a stored transaction.
TXN_COLUMNS = [
    "txn_id", "txn_category", "txn_type", "sender_id", "receiver_id",
    "sender_customer_no", "receiver_customer_no", "sender_name", "receiver_name",
    "sender_identity_no", "receiver_identity_no", "sender_branch", "receiver_branch",
    "sender_country", "receiver_country", "txn_description", "branch_id",
    "amount", "currency", "amount_eur", "country_code",
    "is_customer_sender", "is_customer_receiver", "is_synthetic_fraud", "fraud_type",
    "ts", "ingested_at",
]


def normalize_parties(df: DataFrame) -> DataFrame:
    """One customer key per side; an external receiver's id becomes its customer number."""
    sender = F.coalesce("sender_customer_no", "sender_id", "account_id")
    receiver = F.coalesce("receiver_customer_no", "receiver_id")
    return df.withColumns(
        {
            "sender_customer_no": sender,
            "sender_id": sender,
            "receiver_customer_no": receiver,
            "receiver_id": receiver,
        }
    )


def apply_defaults(df: DataFrame) -> DataFrame:
    branch = F.coalesce("branch_id", "sender_branch", F.lit("BR-001"))
    return df.withColumns(
        {
            "txn_category": F.coalesce("txn_category", F.lit("Wire")),
            "txn_type": F.coalesce("txn_type", F.lit("FAST")),
            "branch_id": branch,
            "sender_branch": F.coalesce(F.col("sender_branch"), branch),
            "country_code": F.coalesce(
                "country_code", "sender_country", "receiver_country", F.lit("DE")
            ),
            "currency": F.coalesce("currency", F.lit("EUR")),
        }
    )


def to_eur(df: DataFrame, rates: Mapping[str, Decimal] = FX_TO_EUR) -> DataFrame:
    """Fill a missing EUR amount; a given one is kept. The filled value is not rounded."""
    given = F.col("amount_eur").cast("decimal(28,5)")
    return df.withColumn("amount_eur", F.coalesce(given, in_eur(F.col("amount"), F.col("currency"), rates)))


def project_txn(df: DataFrame, ingested_at: Column | str) -> DataFrame:
    """The stored transaction row: flag defaults, money as two-digit decimals, parsed event time."""
    return df.withColumns(
        {
            "amount": money(F.col("amount")),
            "amount_eur": money(F.col("amount_eur")),
            "is_customer_sender": F.coalesce("is_customer_sender", F.lit(True)),
            "is_customer_receiver": F.coalesce("is_customer_receiver", F.lit(False)),
            "is_synthetic_fraud": F.coalesce("is_synthetic_fraud", F.lit(False)),
            "ts": F.to_timestamp("ts"),
        }
    ).withColumn("ingested_at", as_col(ingested_at)).select(*TXN_COLUMNS)


def normalize(df: DataFrame, ingested_at: Column | str) -> DataFrame:
    """Wire payments to stored transactions."""
    return project_txn(to_eur(apply_defaults(normalize_parties(df))), ingested_at)


def scope(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def synthetic_only() -> Column:
    """The predicate that limits rules to scenario-driven payments."""
    return F.coalesce(F.col("is_synthetic_fraud"), F.lit(False))


def alert_subject() -> Column:
    """The customer an alert is raised on: the receiving customer if there is one, else the sender."""
    receives = F.coalesce(F.col("is_customer_receiver"), F.lit(False))
    return F.when(
        receives & F.col("receiver_customer_no").isNotNull(), F.col("receiver_customer_no")
    ).otherwise(F.coalesce("sender_customer_no", "sender_id"))


def dedupe_txns(df: DataFrame) -> DataFrame:
    """Drop repeats of (sender, receiver, EUR amount, event time)."""
    return df.dropDuplicates(["sender_id", "receiver_id", "amount_eur", "event_ts"])


def dedupe_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys))


def backfill_parties(df: DataFrame) -> DataFrame:
    """Fill branch, countries and description, only in rows that lack one of the trigger columns."""
    todo = (
        F.col("sender_branch").isNull()
        | F.col("sender_country").isNull()
        | F.col("txn_description").isNull()
    )
    described = F.coalesce(
        F.col("txn_description"), F.concat("txn_type", F.lit(" — "), "txn_category")
    )
    fills = {
        "sender_branch": F.coalesce("sender_branch", "branch_id"),
        "sender_country": F.coalesce("sender_country", "country_code"),
        "receiver_country": F.coalesce("receiver_country", "country_code"),
        "txn_description": described,
    }
    return df.withColumns({c: F.when(todo, v).otherwise(F.col(c)) for c, v in fills.items()})


def backfill_customers(df: DataFrame, dormant_from: str, dormant_to: str) -> DataFrame:
    """Fill missing customer attributes; hash buckets give a stable choice per customer."""
    key = F.col("customer_id")
    stable_no = F.lpad(F.pmod(F.xxhash64(key), F.lit(100_000_000_000)).cast("string"), 11, "0")
    return df.withColumns(
        {
            "onboarding_date": F.coalesce(F.col("onboarding_date"), F.to_date("created_at")),
            "onboarding_channel": F.coalesce(
                F.col("onboarding_channel"), text.bucket_of(key, ONBOARDING_CHANNELS)
            ),
            "country": F.coalesce(F.col("country"), text.bucket_of(key, COUNTRIES)),
            "identity_no": F.when(text.missing(F.col("identity_no")), stable_no).otherwise(
                F.col("identity_no")
            ),
            "customer_status": F.when(key.between(dormant_from, dormant_to), F.lit("dormant")).otherwise(
                F.col("customer_status")
            ),
        }
    )


def fill_blank(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, text.blank_to(F.col(column), value))


def _grouped(col: Column, digits: int) -> Column:
    return F.format_number(col, digits)


def format_alerts(alerts: DataFrame, as_of) -> DataFrame:
    """Compact display columns of an alert joined with its transaction."""
    amount = F.concat(_grouped(F.col("amount"), 0), F.lit(" "), F.col("currency"))
    origin = F.coalesce(F.col("sender_country"), F.lit(text.DASH))
    target = F.coalesce(F.col("receiver_country"), F.col("country_code"), F.lit(text.DASH))
    return alerts.select(
        "txn_id",
        F.col("rule_name").alias("rule"),
        F.coalesce(F.col("window_type"), F.lit(text.DASH)).alias("window"),
        F.coalesce(amount, F.lit(text.DASH)).alias("amount"),
        F.coalesce(F.concat(F.lit("€"), _grouped(F.col("amount_eur"), 0)), F.lit(text.DASH)).alias("eur"),
        F.concat(origin, F.lit(" → "), target).alias("route"),
        F.coalesce(F.col("sender_name"), F.lit("External")).alias("sender"),
        F.coalesce(F.col("receiver_name"), F.lit(text.DASH)).alias("receiver"),
        relative_age(F.col("flagged_at"), as_of).alias("flagged"),
        F.substring(F.coalesce(F.col("rule_detail"), F.lit("")), 1, 60).alias("detail"),
    )


def format_transactions(txns: DataFrame) -> DataFrame:
    """Display columns of transactions: masked identities, dashes for gaps, grouped amounts."""
    dashed = [
        "sender_branch", "receiver_branch", "sender_country", "receiver_country",
        "sender_customer_no", "receiver_customer_no",
    ]
    amount = F.concat(_grouped(F.col("amount"), 2), F.lit(" "), F.col("currency"))
    return txns.select(
        "txn_id",
        "txn_category",
        "txn_type",
        *[F.coalesce(F.col(c), F.lit(text.DASH)).alias(c) for c in dashed],
        text.mask_identity(F.col("sender_identity_no")).alias("sender_id_no"),
        text.mask_identity(F.col("receiver_identity_no")).alias("receiver_id_no"),
        F.coalesce(amount, F.lit(text.DASH)).alias("trx_amount"),
        F.coalesce(_grouped(F.col("amount_eur"), 2), F.lit(text.DASH)).alias("eur_amount"),
    )
