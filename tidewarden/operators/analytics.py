"""KPIs, trends, segmentation, corridors and the customer view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.config import (
    KYC_CHANNEL_POINTS,
    KYC_COUNTRY_POINTS,
    KYC_HIGH_RISK_COUNTRIES,
    KYC_PEP_POINTS,
    KYC_SEGMENT_POINTS,
)
from tidewarden.functions.calendar import as_col, days_before, hours_before, midnight
from tidewarden.functions.money import per_thousand, percent
from tidewarden.functions.text import customer_number
from tidewarden.operators.alerts import page


def _rows() -> Column:
    return F.count(F.lit(1))


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side: stacked, then folded, without any join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def sender() -> Column:
    return F.coalesce("sender_customer_no", "sender_id")


def kyc_risk_score(customers: DataFrame) -> DataFrame:
    """Score 0..100 from segment, exposure, channel and country."""

    def points(column: str, table: dict[str, int], other: int) -> Column:
        lookup = F.create_map(*[F.lit(p) for pair in table.items() for p in pair])
        return F.coalesce(F.try_element_at(lookup, F.col(column)), F.lit(other))

    total = (
        points("segment", KYC_SEGMENT_POINTS, KYC_SEGMENT_POINTS["retail"])
        + F.when(F.col("is_pep"), KYC_PEP_POINTS).otherwise(0)
        + points("onboarding_channel", KYC_CHANNEL_POINTS, 0)
        + F.when(F.col("country").isin(KYC_HIGH_RISK_COUNTRIES), KYC_COUNTRY_POINTS).otherwise(0)
    )
    return customers.withColumn("risk_score", F.least(total, F.lit(100)).cast("decimal(5,2)"))


def dashboard_kpis(flags: DataFrame, txns: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    return one_row(
        flags.agg(
            _rows().alias("total_alerts"),
            F.count_if(F.col("flagged_at") >= hours_before(as_of, 24)).alias("alerts_24h"),
        ),
        txns.filter(F.col("ingested_at") >= midnight(as_of)).agg(_rows().alias("txns_today")),
        customers.agg(_rows().alias("customers")),
    )


def summary_metrics(txns: DataFrame, flags: DataFrame, reports: DataFrame) -> DataFrame:
    return one_row(
        txns.agg(_rows().alias("total_ingested")),
        flags.agg(_rows().alias("total_flagged")),
        reports.agg(_rows().alias("total_sar")),
    )


def risk_bands(customers: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    band = F.when(score < 50, "low_risk").when(score < 75, "medium_risk").otherwise("high_risk")
    return (
        customers.groupBy(band.alias("risk_band"))
        .agg(_rows().alias("customer_count"), F.min(score).alias("lowest"))
        .orderBy("lowest")
        .drop("lowest")
    )


def risk_bands_explorer(customers: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    band = F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")
    return customers.groupBy(band.alias("band")).agg(_rows().alias("customers")).orderBy(F.desc("customers"))


def alerts_by_rule(flags: DataFrame, since: Column | None = None) -> DataFrame:
    df = flags if since is None else flags.filter(F.col("flagged_at") >= since)
    return (
        df.groupBy("rule_name").agg(_rows().alias("alert_count")).orderBy(F.desc("alert_count"), "rule_name")
    )


def alerts_by_rule_24h(flags: DataFrame, as_of) -> DataFrame:
    return alerts_by_rule(flags, hours_before(as_of, 24))


def alerts_by_rule_hourly(flags: DataFrame, as_of) -> DataFrame:
    return (
        flags.filter(F.col("flagged_at") >= hours_before(as_of, 24))
        .groupBy("rule_name", F.date_trunc("hour", "flagged_at").alias("hour_bucket"))
        .agg(_rows().alias("alert_count"))
        .orderBy("hour_bucket", "rule_name")
    )


def txn_trend(txns: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        txns.filter(F.col("ts") >= days_before(as_of, days))
        .groupBy(F.to_date("ts").alias("day"))
        .agg(_rows().alias("txn_count"), F.coalesce(F.sum("amount_eur"), F.lit(0)).alias("volume_eur"))
        .orderBy("day")
    )


def alert_grid(flags: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Alerts per day and rule without gaps, with the sum of the seven days up to each day.

    Every rule that raised an alert in the span is given a row for each of its days; a day without alerts counts zero.
    """
    last = F.to_date(as_col(as_of))
    first = F.date_sub(last, days - 1)
    counted = (
        flags.filter(F.to_date("flagged_at").between(first, last))
        .groupBy("rule_name", F.to_date("flagged_at").alias("day"))
        .agg(_rows().alias("n"))
    )
    every = counted.select("rule_name").distinct().withColumn("day", F.explode(F.sequence(first, last)))
    week = Window.partitionBy("rule_name").orderBy("day").rowsBetween(-6, 0)
    return (
        every.join(counted, ["rule_name", "day"], "left")
        .select("rule_name", "day", F.coalesce("n", F.lit(0)).alias("alerts"))
        .withColumn("alerts_7d", F.sum("alerts").over(week))
    )


def alert_trend(flags: DataFrame, txns: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Alerts by alert day against payments by event day."""
    since = days_before(as_of, days)
    alerts = (
        flags.filter(F.col("flagged_at") >= since)
        .groupBy(F.to_date("flagged_at").alias("day"))
        .agg(_rows().alias("n"))
    )
    paid = txns.filter(F.col("ts") >= since).groupBy(F.to_date("ts").alias("day")).agg(_rows().alias("txns"))
    count = F.coalesce(F.col("n"), F.lit(0))
    return (
        paid.join(alerts, "day", "left")
        .select("day", count.alias("alerts"), "txns", per_thousand(count, F.col("txns")).alias("alerts_per_1k"))
        .orderBy("day")
    )


def acquisition_trend(log: DataFrame, customers: DataFrame, as_of, days: int = 90) -> DataFrame:
    channel = customers.select("customer_id", "onboarding_channel")
    return (
        log.filter(F.col("acquired_at") >= days_before(as_of, days))
        .join(channel, "customer_id", "left")
        .groupBy(
            F.to_date("acquired_at").alias("day"),
            F.coalesce("onboarding_channel", F.lit("Unknown")).alias("channel"),
        )
        .agg(_rows().alias("new_customers"))
        .orderBy("day", "channel")
    )


def segmentation(
    txns: DataFrame, flags: DataFrame, customers: DataFrame, as_of, dim: str = "segment"
) -> DataFrame:
    """Payments, volume and alert rate by customer segment, channel or payment type.

    Payments are summed per customer before the customer join, so the join sees one row per customer.
    """
    since = days_before(as_of, 30)
    paid, raised = txns.filter(F.col("ts") >= since), flags.filter(F.col("flagged_at") >= since)
    if dim == "txn_type":
        volumes = paid.groupBy(F.col("txn_type").alias("dim")).agg(
            _rows().alias("txn_count"), F.sum("amount_eur").alias("volume")
        )
        # An alert carries the time of its payment: the span of these times bounds the scan, and payments without an
        # alert are dropped before the join.
        first, last = raised.agg(F.min("ts"), F.max("ts")).first()
        known = txns.filter(F.col("ts").between(F.lit(first), F.lit(last))).select("txn_id", F.col("txn_type").alias("dim"))
        per_txn = raised.groupBy("txn_id").agg(_rows().alias("n"))
        alerts = known.join(per_txn, "txn_id").groupBy("dim").agg(F.sum("n").alias("alert_count"))
    else:
        attribute = customers.select("customer_id", F.col(dim).alias("dim"))
        volumes = (
            paid.groupBy(sender().alias("customer_id"))
            .agg(_rows().alias("n"), F.sum("amount_eur").alias("v"))
            .join(attribute, "customer_id")
            .groupBy("dim")
            .agg(F.sum("n").alias("txn_count"), F.sum("v").alias("volume"))
        )
        alerts = (
            raised.groupBy("customer_id")
            .agg(_rows().alias("n"))
            .join(attribute, "customer_id")
            .groupBy("dim")
            .agg(F.sum("n").alias("alert_count"))
        )
    count = F.coalesce(F.col("alert_count"), F.lit(0))
    return (
        volumes.filter(F.col("dim").isNotNull())
        .join(alerts, "dim", "left")
        .select(
            "dim",
            "txn_count",
            F.coalesce("volume", F.lit(0)).alias("volume"),
            count.alias("alert_count"),
            per_thousand(count, F.col("txn_count")).alias("alerts_per_1k"),
        )
        .orderBy(F.desc("volume"), "dim")
    )


def geo_corridors(txns: DataFrame, flags: DataFrame, as_of, limit: int = 12) -> DataFrame:
    """Top cross-border corridors by volume.

    A payment with several alerts counts once per alert, as a plain left join would make it; here the
    alerts are counted per payment first and the factor is applied to the sums.
    """
    per_txn = flags.groupBy("txn_id").agg(_rows().alias("n"))
    cross = txns.filter(
        (F.col("ts") >= days_before(as_of, 30)) & (F.col("sender_country") != F.col("receiver_country"))
    ).select("txn_id", "sender_country", "receiver_country", "amount_eur")
    copies = F.coalesce(F.col("n"), F.lit(1))
    return (
        cross.join(per_txn, "txn_id", "left")
        .groupBy("sender_country", "receiver_country")
        .agg(
            F.sum(copies).alias("txn_count"),
            F.coalesce(F.sum(F.col("amount_eur") * copies), F.lit(0)).alias("volume"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("alert_count"),
        )
        .orderBy(F.desc("volume"), "sender_country", "receiver_country")
        .limit(limit)
    )


def _incidence(txns: DataFrame, flags: DataFrame, customers: DataFrame, as_of, group: Column, name: str) -> DataFrame:
    since = days_before(as_of, 30)
    active = txns.filter(F.col("ts") >= since).select(sender().alias("customer_id")).distinct()
    flagged = (
        flags.filter(F.col("flagged_at") >= since).select("customer_id").distinct().withColumn("hit", F.lit(1))
    )
    return (
        customers.select("customer_id", group.alias(name))
        .join(active, "customer_id", "left_semi")
        .join(flagged, "customer_id", "left")
        .groupBy(name)
        .agg(_rows().alias("active_customers"), F.count("hit").alias("flagged_customers"))
        .withColumn("incidence_pct", percent(F.col("flagged_customers"), F.col("active_customers")))
    )


def risk_incidence(txns: DataFrame, flags: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    """Share of active customers with an alert, by risk band."""
    score = F.col("risk_score")
    band = (
        F.when(score >= 75, "High (75-100)")
        .when(score >= 50, "Medium (50-74)")
        .when(score >= 25, "Low (25-49)")
        .otherwise("Minimal (0-24)")
    )
    return _incidence(txns, flags, customers, as_of, band, "band")


def pep_incidence(txns: DataFrame, flags: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    return _incidence(txns, flags, customers, as_of, F.col("is_pep"), "is_pep")


def priority_by_rule(flags: DataFrame, as_of=None) -> DataFrame:
    """Mean priority per rule, all time or over 30 days."""
    df = flags if as_of is None else flags.filter(F.col("flagged_at") >= days_before(as_of, 30))
    return df.groupBy("rule_name").agg(
        # Ten digits before rounding: ``avg`` of a decimal keeps six, which could round twice.
        F.round(
            F.sum("alert_priority_score").cast("decimal(28,10)") / F.count("alert_priority_score"), 1
        ).alias("avg_priority"),
        _rows().alias("alerts"),
    )


_TXN_PAGE = [
    "txn_id", "txn_category", "txn_type", "sender_customer_no", "receiver_customer_no",
    "sender_name", "receiver_name", "sender_identity_no", "receiver_identity_no",
    "sender_branch", "receiver_branch", "sender_country", "receiver_country", "txn_description",
    "branch_id", "amount", "currency", "amount_eur", "country_code", "ts", "ingested_at",
]


def customer_txns(
    txns: DataFrame, customer_id: str, as_of=None, limit: int | None = 100
) -> DataFrame:
    """A customer's payments on either side, newest first; with ``as_of`` of the last 30 days."""
    mine = (sender() == customer_id) | (F.col("receiver_customer_no") == customer_id)
    if as_of is not None:
        mine = mine & (F.col("ts") >= days_before(as_of, 30))
    return page(txns.filter(mine).select(*_TXN_PAGE), [F.desc("ts"), F.asc("txn_id")], limit)


def live_txns(txns: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    return page(txns.select(*_TXN_PAGE), [F.desc("ingested_at"), F.asc("txn_id")], limit, offset)


def recent_sent(txns: DataFrame, customer_id: str, limit: int = 20) -> DataFrame:
    columns = [
        "txn_id", "txn_category", "txn_type", "amount", "currency", "amount_eur",
        "receiver_customer_no", "receiver_name", "sender_branch", "receiver_branch",
        "sender_country", "receiver_country", "txn_description", "country_code", "ts",
    ]
    return page(txns.filter(sender() == customer_id).select(*columns), [F.desc("ts"), F.asc("txn_id")], limit)


def customer_360(
    customers: DataFrame, spend: DataFrame, flag_tallies: DataFrame, latest_metrics: DataFrame
) -> DataFrame:
    """Profile of every customer: attributes, 30-day spend, alerts, newest metrics per window type."""
    alerts = flag_tallies.groupBy("customer_id").agg(
        F.sum("cnt").alias("flags_30d"), F.max("last_flagged").alias("last_flagged")
    )
    windows = latest_metrics.groupBy("customer_id").agg(
        *[
            F.max(F.when(F.col("window_type") == w, F.col(c))).alias(f"{w}_{c}")
            for w in ("daily", "weekly", "biweekly", "monthly")
            for c in ("total_volume", "txn_count")
        ]
    )
    # A customer without payments or alerts has zeros.
    return (
        customers.join(spend, "customer_id", "left")
        .join(alerts, "customer_id", "left")
        .join(windows, "customer_id", "left")
        .fillna(0)
    )


def search_customers(customers: DataFrame, q: str, limit: int | None = 20) -> DataFrame:
    like = f"%{q}%"
    hit = F.col("customer_id").ilike(like) | F.col("name").ilike(like)
    columns = [
        "customer_id", "name", "risk_score", "segment", "is_pep", "branch_id",
        "onboarding_date", "onboarding_channel", "customer_status", "identity_no",
    ]
    return page(customers.filter(hit).select(*columns), [F.asc("customer_id")], limit)


def _cuts(text: Column, size: int) -> Column:
    """The substrings of ``size`` characters from every place of the text, shorter ones at its end.

    The lambda has one parameter: a second one, even with a default, would be given the index.
    """
    spots = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(spots, lambda i: F.substring(text, i, F.lit(size)))


def _grams(text: Column) -> Column:
    """All substrings of one to three characters, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[_cuts(text, n) for n in (1, 2, 3)]))


def _anchor(pattern: Column) -> Column:
    """The last one to three characters of the longest part of a LIKE pattern without wildcards."""
    parts = F.split(pattern, r"[%_\\\\]")
    longest = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.right(longest, F.lit(3))


#: Search texts of up to so many characters are looked up as a whole.
LOOKUP_CHARS = 64


def _substrings(text: Column, lengths: list[int]) -> Column:
    """All different substrings of the given lengths, and some shorter ones."""
    return F.array_distinct(F.concat(*[_cuts(text, n) for n in lengths]))


def resolve_targets(queries: DataFrame, customers: DataFrame, flags: DataFrame) -> DataFrame:
    """Resolve search texts in bulk: customer id, else newest alert of a payment, else part of a name.

    All matches are equi joins. A text without wildcards is looked up among the substrings of ids and names that
    have the length of some text; each substring has its smallest customer id, found in every task before the
    shuffle, so one that all customers share costs a row per task and no text meets more than one row. For texts
    with wildcards, customers are looked up by the short substrings that such a text asks for and checked with ``ILIKE``.
    """
    asked = queries.select("q", F.trim("q").alias("sid")).filter(F.col("sid") != "").distinct()
    by_id = (
        asked.filter(F.startswith(F.upper("sid"), F.lit("CUST-")))
        .join(customers.select("customer_id"), F.col("sid") == F.col("customer_id"))
        .select("q", "sid", F.lit("customer").alias("mode"), "customer_id")
    )
    left = asked.join(by_id.select("q"), "q", "left_anti")
    newest = flags.groupBy("txn_id").agg(
        F.min(F.struct((-F.unix_micros("flagged_at")).alias("age"), "rule_name", "customer_id")).alias("f")
    )
    by_alert = left.join(newest, F.col("sid") == F.col("txn_id")).select(
        "q", "sid", F.lit("alert").alias("mode"), "f.customer_id", "txn_id", "f.rule_name"
    )
    left = left.join(by_alert.select("q"), "q", "left_anti").withColumn("part", F.lower("sid"))
    plain = ~F.col("sid").rlike(r"[%_\\\\]") & (F.length("part") <= LOOKUP_CHARS)
    wanted = asked.select(F.length(F.lower("sid")).alias("n")).filter(F.col("n") <= LOOKUP_CHARS)
    lengths = sorted(row["n"] for row in wanted.distinct().collect()) or [1]
    both = F.array_union(
        _substrings(F.lower("customer_id"), lengths), _substrings(F.lower(F.coalesce("name", F.lit(""))), lengths)
    )
    index = customers.select("customer_id", F.explode(both).alias("part")).groupBy("part").agg(F.min("customer_id").alias("customer_id"))
    by_part = left.filter(plain).join(index, "part").select("q", "sid", F.lit("customer").alias("mode"), "customer_id")
    left = left.filter(~plain).withColumn("gram", _anchor(F.col("part")))
    named = customers.select(
        F.col("customer_id").alias("found"),
        "name",
        F.explode(
            F.array_union(_grams(F.lower("customer_id")), _grams(F.lower(F.coalesce("name", F.lit("")))))
        ).alias("gram"),
    ).join(left.select("gram").distinct(), "gram", "left_semi")
    like = F.expr("name ILIKE concat('%', sid, '%') OR found ILIKE concat('%', sid, '%')")
    by_name = (
        named.join(left, "gram")
        .filter(like)
        .groupBy("q", "sid")
        .agg(F.min("found").alias("customer_id"))
        .withColumn("mode", F.lit("customer"))
    )
    return (
        by_id.unionByName(by_alert, allowMissingColumns=True)
        .unionByName(by_part, allowMissingColumns=True)
        .unionByName(by_name, allowMissingColumns=True)
        .select("q", "mode", "customer_id", "txn_id", "rule_name")
    )


def customer_addresses(addresses: DataFrame, customer_id: str) -> DataFrame:
    return (
        addresses.filter(F.col("customer_id") == customer_id)
        .select("address_id", "city", "district", "country_code", "address_type")
        .orderBy("address_type", "address_id")
    )


def customer_by_id(customers: DataFrame, customer_id: str) -> DataFrame:
    return customers.filter(F.col("customer_id") == customer_id)


def active_customers(customers: DataFrame) -> DataFrame:
    return customers.filter(F.col("customer_status") == "active")


def behavior_by_id(behavior: DataFrame, customer_id: str) -> DataFrame:
    return behavior.filter(F.col("customer_id") == customer_id)


def sample_customers(customers: DataFrame, status: str = "active", n: int = 500, seed: int = 42) -> DataFrame:
    """A random sample of customers of one status; each task keeps at most ``n`` rows."""
    pool = customers.filter(F.col("customer_status") == status)
    return pool.orderBy(F.xxhash64(F.lit(seed), "customer_id"), "customer_id").limit(n)


def next_customer_id(customers: DataFrame) -> DataFrame:
    """The key after the numerically largest one."""
    top = F.coalesce(F.max(customer_number(F.col("customer_id"))), F.lit(0))
    text = (top + 1).cast("string")
    # ``lpad`` would cut numbers longer than seven digits.
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(7)), F.lit("0"))
    return customers.agg(F.concat(F.lit("CUST-"), padded).alias("next_customer_id"))


# --- canned explorer questions -------------------------------------------------------------------


def explorer_txn_latest(txns: DataFrame) -> DataFrame:
    columns = ["txn_id", "sender_customer_no", "receiver_customer_no", "amount_eur", "currency", "ingested_at"]
    return page(txns.select(*columns), [F.desc("ingested_at"), F.asc("txn_id")], 20)


def explorer_txn_high_value(txns: DataFrame) -> DataFrame:
    columns = ["txn_id", "sender_customer_no", "amount_eur", "currency", "ts"]
    return page(
        txns.filter(F.col("amount_eur") >= 5000).select(*columns), [F.desc("amount_eur"), F.asc("txn_id")], 15
    )


def explorer_txn_by_country(txns: DataFrame) -> DataFrame:
    return (
        txns.filter(F.col("sender_country").isNotNull())
        .groupBy("sender_country")
        .agg(_rows().alias("txns"), F.round(F.sum("amount_eur"), 2).alias("volume_eur"))
        .orderBy(F.desc("volume_eur"), "sender_country")
        .limit(10)
    )


def explorer_cust_pep(customers: DataFrame) -> DataFrame:
    columns = ["customer_id", "name", "risk_score", "segment", "country"]
    return page(customers.filter("is_pep").select(*columns), [F.desc("risk_score"), F.asc("customer_id")], 20)


def explorer_cust_addresses(addresses: DataFrame) -> DataFrame:
    counts = addresses.groupBy("customer_id").agg(_rows().alias("address_count"))
    return page(counts, [F.desc("address_count"), F.asc("customer_id")], 15)


def explorer_cust_acquired(log: DataFrame) -> DataFrame:
    days = log.groupBy(F.to_date("acquired_at").alias("day")).agg(_rows().alias("new_customers"))
    return page(days, [F.desc("day")], 14)


def explorer_alert_hourly(flags: DataFrame, as_of) -> DataFrame:
    return (
        flags.filter(F.col("flagged_at") >= days_before(as_of, 7))
        .groupBy(F.date_trunc("hour", "flagged_at").alias("hour"))
        .agg(_rows().alias("alerts"))
        .orderBy(F.desc("hour"))
    )


def explorer_alert_archive(archive_counts: DataFrame) -> DataFrame:
    order = [F.desc("first_archived"), F.asc("alert_txn_id"), F.asc("rule_name")]
    return page(archive_counts, order, 20)


def explorer_pipe_metrics(metrics: DataFrame) -> DataFrame:
    columns = ["metric_key", "metric_value", "recorded_at"]
    return page(metrics.select(*columns), [F.desc("recorded_at"), F.asc("metric_key")], 20)


def explorer_pipe_windows(window_metrics: DataFrame) -> DataFrame:
    return window_metrics.groupBy("window_type").agg(
        _rows().alias("rows"), F.max("computed_at").alias("latest")
    )


def explorer_pipe_behavior(behavior: DataFrame) -> DataFrame:
    columns = ["customer_id", "txn_count_30d", "volume_30d", "last_txn_at"]
    return page(behavior.select(*columns), [F.desc_nulls_last("volume_30d"), F.asc("customer_id")], 15)


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Newest row per key; the row limit is applied in each task before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")

