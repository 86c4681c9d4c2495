"""Payments, customers and their side tables derived from the given test tables.

``events`` are payments, ``customer`` is the customer master, ``orders`` give acquisition times. The
modulo terms plant the defects that the data-quality checks look for.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.config import ADDRESS_TYPES, CITIES, FX_TO_EUR
from tidewarden.operators.analytics import kyc_risk_score
from tidewarden.sources.schema import WIRE_SCHEMA

AS_OF = "2024-01-30 23:59:59"
ACQUISITION_AS_OF = "2001-08-02 00:00:00"

# Countries by number.
_COUNTRIES = ["DE", "TR", "FR", "NL", "AT", "BE", "IT", "ES", "PL", "CH", "RU", "KP"]
_CURRENCIES = ["EUR", "USD", "TRY", "GBP", "CHF"]
_CHANNELS = ["Mobile", "Branch", "Web", "ATM"]
_SOURCES = ["generator", "spark", "sar", "ml", "airflow"]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _customer_key(number: Column) -> Column:
    return F.concat(F.lit("CUST-"), F.lpad(number.cast("string"), 7, "0"))


def _identity(number: Column) -> Column:
    return F.lpad((number.cast("bigint") * 7654321 % 100_000_000_000).cast("string"), 11, "0")


def _branch(number: Column) -> Column:
    return F.concat(F.lit("BR-"), F.lpad((number % 12 + 1).cast("string"), 3, "0"))


def customers(customer: DataFrame) -> DataFrame:
    g = F.col("c_custkey")
    return kyc_risk_score(
        customer.select(
            _customer_key(g).alias("customer_id"),
            _identity(g).alias("identity_no"),
            F.col("c_name").alias("name"),
            F.date_sub(F.lit("2024-01-31").cast("date"), (g * 17 % 1825).cast("int")).alias("onboarding_date"),
            _pick(_CHANNELS, g % 4).alias("onboarding_channel"),
            F.when(g % 10 == 0, "corporate").when(g % 7 == 0, "premium").otherwise("retail").alias("segment"),
            (g % 25 == 0).alias("is_pep"),
            _branch(g).alias("branch_id"),
            _pick(_COUNTRIES, g % 12).alias("country"),
            F.when(g % 20 == 0, "dormant").otherwise("active").alias("customer_status"),
        )
    )


def payments(events: DataFrame) -> DataFrame:
    """Events as payments in the wire layout, but with exact decimal amounts and a timestamp."""
    # Shared terms are columns of their own, so that they are evaluated once per row.
    number = F.get_json_object("props", "$.k").cast("int")
    events = events.select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("u"),
        F.col("event_type").alias("kind"),
        "ts",
        (F.col("value").cast("decimal(18,2)") * F.lit(Decimal(40))).alias("base"),
        number.alias("k"),
    ).select(
        "*",
        (F.col("kind") == "signup").alias("inbound"),
        F.when(F.col("kind") == "signup", F.col("k") % 10).when(F.col("k") % 4 == 0, F.col("k")).alias("receiver_no"),
    ).select(
        "*",
        _customer_key(F.col("receiver_no")).alias("receiver"),
        F.when(~F.col("inbound"), _customer_key(F.col("u"))).alias("sender"),
        _pick(_COUNTRIES, (F.col("u") + F.when(F.col("e") % 97 == 0, 1).otherwise(0)) % 12).alias("sender_country"),
        _pick(_COUNTRIES, (F.col("k") + F.when(F.col("e") % 67 == 0, 1).otherwise(0)) % 10).alias("receiver_country"),
    )
    e, u, k, base, kind = (F.col(c) for c in ("e", "u", "k", "base", "kind"))
    inbound, receiver_no, receiver, sender = (F.col(c) for c in ("inbound", "receiver_no", "receiver", "sender"))
    sender_country, receiver_country = F.col("sender_country"), F.col("receiver_country")
    internal = receiver_no.isNotNull()
    rate = _pick([FX_TO_EUR[c] for c in _CURRENCIES], k % 5).cast("decimal(9,3)")
    drift = F.when(e % 83 == 0, F.lit(Decimal("1.05"))).otherwise(F.lit(Decimal("1.00")))
    columns = {
        "txn_id": e.cast("string"),
        "txn_category": F.when(kind == "signup", "Cash").when(kind == "error", "BackOffice").otherwise("Wire"),
        "txn_type": F.when(kind == "click", "FAST").when(kind == "view", "SEPA")
        .when(kind == "purchase", "SWIFT").when(kind == "signup", "ATM_DEPOSIT").otherwise("ADJUSTMENT"),
        "sender_id": sender,
        "receiver_id": F.coalesce(receiver, F.concat(F.lit("EXT-"), k.cast("string"))),
        "sender_customer_no": sender,
        "receiver_customer_no": receiver,
        "sender_name": F.when(e % 89 == 0, F.lit(None)).when(e % 71 == 0, F.concat(F.lit("Alias "), u.cast("string")))
        .otherwise(F.concat(F.lit("Customer "), u.cast("string"))),
        "receiver_name": F.when(e % 61 == 0, F.concat(F.lit("Ext alias "), k.cast("string")))
        .when(internal, F.concat(F.lit("Customer "), receiver_no.cast("string")))
        .otherwise(F.concat(F.lit("External "), k.cast("string"))),
        "sender_identity_no": _identity(u),
        "receiver_identity_no": F.when(internal, _identity(receiver_no)).otherwise(
            F.concat(F.lit("9"), F.lpad(k.cast("string"), 10, "0"))
        ),
        "sender_branch": F.when(inbound, F.lit(None)).when(e % 79 == 0, F.lit("BR-099")).otherwise(_branch(u)),
        "receiver_branch": F.when(internal, _branch(receiver_no)),
        "sender_country": sender_country,
        "receiver_country": receiver_country,
        "amount": F.round(base, 2),
        "currency": _pick(_CURRENCIES, k % 5),
        "amount_eur": F.round(base * rate * drift, 2),
        "country_code": F.coalesce(sender_country, receiver_country),
        "is_customer_sender": ~inbound,
        "is_customer_receiver": internal,
        "ts": F.col("ts").cast("timestamp"),
        "is_synthetic_fraud": kind.isin("purchase", "error", "signup"),
    }
    typed = {f.name: f.dataType for f in WIRE_SCHEMA}
    return events.select(
        *[columns.get(n, F.lit(None).cast(t)).alias(n) for n, t in typed.items()]
    )


def address_expand(customers: DataFrame) -> DataFrame:
    """One to five addresses per customer; the customer's number fixes count, city and types."""
    number = F.regexp_replace("customer_id", r"\D", "").try_cast("bigint")
    types = F.array(*[F.lit(t) for t in ADDRESS_TYPES])
    cities = F.array(*[F.lit(c) for c in CITIES])
    return (
        customers.select("customer_id", F.coalesce("country", F.lit("DE")).alias("country_code"), number.alias("g"))
        .withColumn("n", F.explode(F.sequence(F.lit(1), (F.col("g") % 5 + 1).cast("int"))))
        .select(
            (F.col("g") * 10 + F.col("n")).alias("address_id"),
            "customer_id",
            F.element_at(cities, (F.col("g") % 10 + 1).cast("int")).alias("city"),
            F.concat(F.lit("District "), ((F.col("g") + F.col("n")) % 20 + 1).cast("string")).alias("district"),
            "country_code",
            F.element_at(types, ((F.col("g") + F.col("n")) % 5 + 1).cast("int")).alias("address_type"),
        )
    )


def acquisition_log(orders: DataFrame) -> DataFrame:
    return orders.groupBy(_customer_key(F.col("o_custkey")).alias("customer_id")).agg(
        F.min(F.col("o_orderdate").cast("timestamp")).alias("acquired_at")
    )


def event_log(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _pick(_SOURCES, F.col("user_id") % 5).alias("source"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "CRITICAL").otherwise("WARNING").alias("level"),
        kind.alias("logger"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("message"),
    )


def job_runs(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("job_"), (F.col("user_id") % 6).cast("string")).alias("dag_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("state"),
        F.col("ts").cast("timestamp").alias("start_date"),
        F.col("event_id").alias("run_id"),
    )


def dispositions(flags: DataFrame) -> DataFrame:
    number = F.col("txn_id").try_cast("bigint")
    return flags.filter(number % 5 == 0).select(
        "txn_id",
        "rule_name",
        F.when(number % 2 == 0, "false_positive").otherwise("sar_filed").alias("disposition"),
        F.lit(None).cast("string").alias("analyst_notes"),
        (F.col("flagged_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    )


def filed_reports(flags: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Reports already filed: one per flagged account whose customer number divides by three."""
    number = F.regexp_replace("account_id", r"\D", "").try_cast("bigint")
    return (
        flags.filter(number % 3 == 0)
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("flagged_count"))
        .select(
            F.concat(F.lit("R-"), F.col("account_id")).alias("report_id"),
            F.substring(F.sha2("account_id", 256), 1, 16).alias("account_id_hash"),
            F.col("account_id").alias("customer_id"),
            "flagged_count",
            F.lit("earlier report").alias("report_text"),
            F.lit("template").alias("model_used"),
            F.lit("System").alias("filed_by"),
            (F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("created_at"),
        )
    )
