"""Customer context and party joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.heavy import salted_join

_KYC = {
    "identity_no": "cust_identity_no",
    "name": "cust_name",
    "onboarding_channel": "cust_onboarding_channel",
    "risk_score": "cust_risk_score",
    "segment": "cust_segment",
    "customer_status": "cust_status",
}


def primary_address(addresses: DataFrame, address_type: str = "home") -> DataFrame:
    """First address of a type per customer, by address id."""
    first = F.min(F.struct("address_id", "city", "district", "country_code"))
    return (
        addresses.filter(F.col("address_type") == address_type)
        .groupBy("customer_id")
        .agg(first.alias("a"))
        .select("customer_id", "a.city", "a.district", "a.country_code")
    )


def enrich_kyc(txns: DataFrame, customers: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Attach customer attributes, and the home address if given, to each transaction's sender.

    No broadcast is forced: Spark broadcasts the dimension only while its measured size allows it, and a
    hot sender's partition is split at run time otherwise.
    """
    kyc = customers.select("customer_id", *[F.col(c).alias(a) for c, a in _KYC.items()])
    anchored = txns.withColumn("anchor_customer_id", F.coalesce("sender_customer_no", "sender_id"))
    context = kyc
    if addresses is not None:
        home = primary_address(addresses).select(
            "customer_id",
            F.col("city").alias("cust_city"),
            F.col("district").alias("cust_district"),
            F.col("country_code").alias("cust_country_code"),
        )
        # Joining the two dimensions first leaves one join on the large side.
        context = kyc.join(home, "customer_id", "full_outer")
    return anchored.join(
        context, F.col("anchor_customer_id") == context["customer_id"], "left"
    ).drop(context["customer_id"])


def by_party(txns: DataFrame) -> DataFrame:
    """One row per transaction and distinct party (sender or receiver) as ``party_id``.

    Turns an OR join on sender / receiver into an equi join; a payment to oneself yields one row.
    """
    parties = F.array_distinct(F.array_compact(F.array("sender_customer_no", "receiver_customer_no")))
    return txns.withColumn("party_id", F.explode(parties))


def for_customers(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions in which one of ``customers`` is sender or receiver, each once."""
    wanted = customers.select(F.col("customer_id").alias("party_id")).distinct()
    hits = by_party(txns).join(wanted, "party_id", "left_semi").drop("party_id")
    return hits.dropDuplicates(["txn_id"])


def party_join(alerts: DataFrame, txns: DataFrame, heavy: Sequence = ()) -> DataFrame:
    """Every alert with every transaction of its customer, on either side.

    ``heavy`` names parties with a large share of the payments (see ``heavy.heavy_keys``); their payments are dealt to
    several tasks.
    """
    sided = by_party(txns.withColumnRenamed("txn_id", "party_txn_id"))
    return salted_join(sided, alerts, "party_id", "customer_id", heavy).drop("party_id")


def missing_addresses(customers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Home and work addresses to add for customers who lack one."""
    wanted = customers.select(
        "customer_id",
        F.coalesce("country", F.lit("DE")).alias("country_code"),
        F.explode(F.array(F.lit("home"), F.lit("work"))).alias("address_type"),
    )
    return wanted.join(addresses, ["customer_id", "address_type"], "left_anti").select(
        "customer_id", "country_code", "address_type"
    )
