"""Detection rules.

A rule run yields one alert per customer and rule: the newest matching payment, ties by transaction id.
With ``per="window"`` that holds per window instance (history, streaming), with ``per="batch"`` per
batch against the metrics of the windows open at one instant. Only dormant reactivation keeps every
matching payment.

Plan shape: the newest matching payment per customer and day is found first, with map-side combine, and
only those few rows are then matched with the metrics. A hot customer therefore costs one row per task
and day, and no join ever sees the raw payments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.config import RULES, SCENARIOS
from tidewarden.functions.calendar import as_col, days_before, window_start
from tidewarden.operators.normalize import alert_subject, scope

# Columns of an alert; rule names and details are output values too.
FLAG_COLUMNS = [
    "txn_id", "customer_id", "account_id", "amount", "currency", "amount_eur", "ts", "merchant",
    "rule_name", "rule_detail", "window_type", "flagged_at",
]

ANY_PAYMENT = None
_DORMANT = "dormant_reactivation"
_MULE = "mule_inbound"


@dataclass(frozen=True)
class PaymentRule:
    """A rule on single payments, optionally tied to a breached window metric."""

    name: str
    window_type: str
    matches: Column | None
    detail: Column
    breached: Column | None = None


def _limit(value) -> Column:
    """A threshold as an exact decimal, so that money columns are compared without a cast."""
    return F.lit(Decimal(str(value)))


def payment_rules(cfg: dict = RULES) -> list[PaymentRule]:
    multi, smurf = cfg["multi_window"], cfg["smurfing"]
    weekly_max = float(multi["weekly_volume_max_eur"])
    daily_max, daily_cap = int(multi["daily_velocity_max"]), float(multi["daily_velocity_max_amount_eur"])
    factor = float(multi["monthly_peer_anomaly_multiplier"])
    monthly_max = int(multi["monthly_peer_baseline_txn_count"]) * factor
    small_max, small_count = float(smurf["weekly_small_txn_threshold_eur"]), int(smurf["weekly_small_txn_count"])
    high_value = float(cfg["high_value"]["threshold_eur"])
    risky = sorted({*cfg["geographic"]["high_risk_countries"], *cfg["geographic"]["blocked_countries"]})
    amount, count, volume = F.col("amount_eur"), F.col("txn_count"), F.col("total_volume")
    return [
        PaymentRule(
            "weekly_volume", "weekly", ANY_PAYMENT,
            F.concat(F.lit("weekly volume "), volume.cast("string"), F.lit(f" EUR exceeds {weekly_max}")),
            volume > _limit(weekly_max),
        ),
        PaymentRule(
            "daily_velocity", "daily", amount <= _limit(daily_cap),
            F.concat(
                F.lit("daily txn_count "), count.cast("string"),
                F.lit(f" exceeds {daily_max} (txns <= {daily_cap} EUR)"),
            ),
            count > daily_max,
        ),
        PaymentRule(
            "monthly_peer_anomaly", "monthly", ANY_PAYMENT,
            F.concat(F.lit("monthly txn_count "), count.cast("string"), F.lit(f" exceeds peer baseline x{factor}")),
            count > _limit(monthly_max),
        ),
        PaymentRule(
            "smurfing", "weekly", amount <= _limit(small_max),
            F.lit(f"weekly activity >= {small_count} with txns under {small_max} EUR"),
            count >= small_count,
        ),
        # Only the first known country is tested.
        PaymentRule(
            "geographic", "daily", F.col("first_country").isin(risky),
            F.concat(F.lit("high-risk country: "), F.col("first_country")),
        ),
        PaymentRule(
            "high_value", "daily", amount > _limit(high_value), F.lit(f"amount_eur exceeds {high_value} EUR"),
        ),
    ]


def _subjects(txns: DataFrame, predicate: Column | None) -> DataFrame:
    """Payments in scope with their alert subject and the fields an alert carries."""
    return (
        scope(txns, predicate)
        .select(
            "txn_id",
            alert_subject().alias("customer_id"),
            F.coalesce("sender_customer_no", "sender_id").alias("account_id"),
            "receiver_customer_no",
            F.col("sender_customer_no").isNull().alias("external_sender"),
            F.coalesce("is_customer_receiver", F.lit(False)).alias("is_customer_receiver"),
            "sender_identity_no",
            "amount",
            "currency",
            F.coalesce("amount_eur", "amount").alias("amount_eur"),
            F.coalesce("sender_country", "receiver_country", "country_code").alias("first_country"),
            "ts",
        )
        .filter(F.col("customer_id").isNotNull())
    )


def _newest_key() -> Column:
    """Struct whose minimum is the newest payment, ties by transaction id."""
    return F.struct(
        (-F.unix_micros("ts")).alias("age"),
        "txn_id", "account_id", "amount", "currency", "amount_eur", "first_country", "ts",
    )


def _candidates(rules: Sequence[PaymentRule]) -> dict[str, str]:
    """Column of the newest match per rule; rules that any payment matches share one."""
    return {r.name: "any_payment" if r.matches is ANY_PAYMENT else r.name for r in rules}


def _as_flags(df: DataFrame, flagged_at: Column) -> DataFrame:
    return (
        df.withColumn("merchant", F.lit(None).cast("string"))
        .withColumn("account_id", F.coalesce("account_id", "customer_id"))
        .withColumn("flagged_at", flagged_at)
        .select(*FLAG_COLUMNS)
    )


def _flag_payment_rules(
    base: DataFrame, metrics: DataFrame, rules: Sequence[PaymentRule], per: str, flagged_at: Column
) -> DataFrame:
    days = [F.date_trunc("day", "ts").alias("day")] if per == "window" else []
    column = _candidates(rules)
    matches = {column[r.name]: r.matches for r in rules}
    picks = base.groupBy("customer_id", *days).agg(
        *[
            F.min(_newest_key() if m is ANY_PAYMENT else F.when(m, _newest_key())).alias(c)
            for c, m in matches.items()
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule_name"),
                F.lit(r.window_type).alias("window_type"),
                (
                    window_start(F.col("day"), r.window_type)
                    if per == "window"
                    else F.lit(None).cast("timestamp")
                ).alias("window_start"),
                F.col(column[r.name]).alias("payment"),
            )
            for r in rules
        ]
    )
    picks = picks.select("customer_id", F.inline(F.filter(entries, lambda e: e["payment"].isNotNull())))
    if per == "window":
        picks = picks.groupBy("customer_id", "rule_name", "window_type", "window_start").agg(
            F.min("payment").alias("payment")
        )
    tied = [r for r in rules if r.breached is not None]
    if tied:
        some_breach = reduce(
            Column.__or__, [(F.col("window_type") == r.window_type) & r.breached for r in tied]
        )
        keys = ["customer_id", "window_type"] + (["window_start"] if per == "window" else [])
        breached = metrics.filter(some_breach).select(*keys, "total_volume", "txn_count")
        picks = picks.join(breached, keys, "left")
        keep = reduce(
            Column.__or__,
            [
                (F.col("rule_name") == r.name) & (F.lit(True) if r.breached is None else r.breached)
                for r in rules
            ],
        )
        picks = picks.filter(keep)
    payment = [f"payment.{c}" for c in ("txn_id", "account_id", "amount", "currency", "amount_eur", "first_country", "ts")]
    metric = ["total_volume", "txn_count"] if tied else []
    rows = picks.select("customer_id", "rule_name", "window_type", *payment, *metric)
    detail = reduce(
        lambda chain, r: chain.when(F.col("rule_name") == r.name, r.detail),
        rules[1:],
        F.when(F.col("rule_name") == rules[0].name, rules[0].detail),
    )
    return _as_flags(rows.withColumn("rule_detail", detail), flagged_at)


def _flag_dormant(
    txns: DataFrame, predicate: Column | None, customers: DataFrame, cfg: dict, flagged_at: Column
) -> DataFrame:
    least = float(cfg[_DORMANT]["min_amount_eur"])
    dormant = customers.filter(F.col("customer_status") == "dormant").select("customer_id")
    # Written on the stored columns, so that the parquet scan can skip row groups.
    large = (F.col("amount_eur") >= _limit(least)) | (
        F.col("amount_eur").isNull() & (F.col("amount") >= _limit(least))
    )
    hits = _subjects(txns.filter(large), predicate).join(dormant, "customer_id", "left_semi")
    return _as_flags(
        hits.withColumns(
            {
                "rule_name": F.lit(_DORMANT),
                "window_type": F.lit("daily"),
                "rule_detail": F.lit(f"dormant account activity >= {least} EUR"),
            }
        ),
        flagged_at,
    )


def _flag_mule(
    base: DataFrame, cfg: dict, per: str, flagged_at: Column, min_total_eur: float | None
) -> DataFrame:
    """Receivers with many distinct external senders, in one pass.

    Senders are grouped per receiver first and counted afterwards; nothing is joined back.
    """
    least = int(cfg[_MULE]["min_distinct_senders"])
    day = [F.date_trunc("day", "ts").alias("day")] if per == "window" else []
    inbound = base.filter(
        F.col("is_customer_receiver") & F.col("receiver_customer_no").isNotNull() & F.col("external_sender")
    )
    per_sender = inbound.groupBy("receiver_customer_no", *day, "sender_identity_no").agg(
        F.sum("amount_eur").alias("total"), F.min(_newest_key()).alias("payment")
    )
    keys = ["receiver_customer_no"] + (["day"] if day else [])
    receivers = per_sender.groupBy(*keys).agg(
        F.count("sender_identity_no").alias("senders"),
        F.sum("total").alias("total"),
        F.min("payment").alias("payment"),
    ).filter(F.col("senders") >= least)
    if min_total_eur is not None:
        receivers = receivers.filter(F.col("total") >= _limit(min_total_eur))
    rows = receivers.select(
        F.col("receiver_customer_no").alias("customer_id"),
        F.col("receiver_customer_no").alias("account_id"),
        *[f"payment.{c}" for c in ("txn_id", "amount", "currency", "amount_eur", "ts")],
        F.lit(_MULE).alias("rule_name"),
        F.lit("daily").alias("window_type"),
        F.lit(f"distinct inbound senders >= {least}").alias("rule_detail"),
    )
    return _as_flags(rows, flagged_at)


def evaluate_rules(
    txns: DataFrame,
    metrics: DataFrame,
    customers: DataFrame,
    cfg: dict = RULES,
    *,
    flagged_at,
    per: str = "window",
    only: Sequence[str] | None = None,
    predicate: Column | None = None,
    mule_min_total_eur: float | None = None,
) -> DataFrame:
    """Alerts of all rules, or of those named in ``only``; unique by transaction and rule."""
    wanted = set(only) if only else None
    base = _subjects(txns, predicate)
    at = as_col(flagged_at)
    parts = []
    rules = [r for r in payment_rules(cfg) if wanted is None or r.name in wanted]
    if rules:
        parts.append(_flag_payment_rules(base, metrics, rules, per, at))
    if wanted is None or _DORMANT in wanted:
        parts.append(_flag_dormant(txns, predicate, customers, cfg, at))
    if wanted is None or _MULE in wanted:
        parts.append(_flag_mule(base, cfg, per, at, mule_min_total_eur))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["txn_id", "rule_name"])


def _single(name: str) -> Callable[..., DataFrame]:
    def rule(txns, metrics, customers, cfg=RULES, **options) -> DataFrame:
        return evaluate_rules(txns, metrics, customers, cfg, only=[name], **options)

    rule.__name__ = f"rule_{name}"
    rule.__doc__ = f"Alerts of the {name} rule alone."
    return rule


rule_weekly_volume = _single("weekly_volume")
rule_daily_velocity = _single("daily_velocity")
rule_monthly_peer = _single("monthly_peer_anomaly")
rule_geographic = _single("geographic")
rule_high_value = _single("high_value")
rule_smurfing = _single("smurfing")
rule_dormant = _single(_DORMANT)
rule_mule_inbound = _single(_MULE)


def rule_velocity(txns: DataFrame, cfg: dict = RULES) -> DataFrame:
    """Accounts with more payments in one window of some minutes than allowed."""
    minutes, most = int(cfg["velocity"]["window_minutes"]), int(cfg["velocity"]["max_txns_per_account"])
    account = F.coalesce("sender_customer_no", "sender_id")
    return (
        txns.filter(account.isNotNull())
        .groupBy(account.alias("account_id"), F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("txn_count"))
        .filter(F.col("txn_count") > most)
        .select("account_id", F.col("w.start").alias("window_start"), "txn_count", F.lit("velocity").alias("rule_name"))
    )


def rule_biweekly_fanout(metrics: DataFrame, cfg: dict = RULES) -> DataFrame:
    """Customers who paid more distinct receivers in two weeks than allowed."""
    most = int(cfg["multi_window"]["biweekly_distinct_receivers_max"])
    return metrics.filter(
        (F.col("window_type") == "biweekly") & (F.col("distinct_receiver_count") > most)
    ).select(
        "customer_id", "window_start", "distinct_receiver_count", F.lit("biweekly_receivers").alias("rule_name")
    )


def scenario_catalog(spark: SparkSession, cfg: dict = RULES) -> DataFrame:
    """Scenarios with the thresholds of their rule and the number of enabled ones."""
    active = sum(1 for s in SCENARIOS if s[6])
    rows = [
        (sid, rule, title, section, weight, most, enabled, {k: str(v) for k, v in cfg[section].items()}, active)
        for sid, rule, title, section, weight, most, enabled in SCENARIOS
    ]
    return spark.createDataFrame(
        rows,
        "scenario_id string, rule_name string, title string, params_key string, priority_weight double, "
        "max_txns_per_inject int, enabled boolean, thresholds map<string,string>, active_scenarios int",
    )


def rule_coverage(catalog: DataFrame, flags: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Alerts per catalog rule in the trailing days; silent rules stay, and come first."""
    recent = (
        flags.filter(F.col("flagged_at") >= days_before(as_of, days))
        .groupBy("rule_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        catalog.select("scenario_id", "rule_name", "enabled")
        .join(recent, "rule_name", "left")
        .select("scenario_id", "rule_name", "enabled", F.coalesce("n", F.lit(0)).alias("alerts_7d"))
        .orderBy("alerts_7d", "rule_name")
    )
