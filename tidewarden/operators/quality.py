"""Data-quality checks and column tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.config import DQ_RULES
from tidewarden.functions.money import in_eur
from tidewarden.functions.text import missing

_PARTY_FIELDS = ["sender_name", "sender_identity_no", "receiver_name", "receiver_identity_no"]


def dq_identity(txns: DataFrame, identity: str, attribute: str, separator: str = ", ", cut: int | None = None) -> DataFrame:
    """Identities seen with more than one value of ``attribute``.

    An identity is in violation if its smallest and largest values differ, which one pass finds, combined in every
    task before the shuffle. Values are made distinct and listed for these identities only.
    """
    value = F.col(attribute) if cut is None else F.substring(attribute, 1, cut)
    known = txns.filter(F.col(identity).isNotNull() & F.col(attribute).isNotNull()).select(
        F.col(identity).alias("entity_id"), F.col(attribute).alias("value"), value.alias("shown")
    )
    extremes = known.groupBy("entity_id").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    violators = extremes.filter(F.col("least") != F.col("most")).select("entity_id")
    pairs = known.join(violators, "entity_id", "left_semi").distinct()
    return (
        pairs.groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("distinct_values"),
            F.array_join(F.array_sort(F.collect_set("shown")), separator).alias("values_seen"),
        )
    )


def dq_sender_country(txns: DataFrame) -> DataFrame:
    return dq_identity(txns, "sender_identity_no", "sender_country")


def dq_sender_name(txns: DataFrame) -> DataFrame:
    return dq_identity(txns, "sender_identity_no", "sender_name", " | ", 40)


def dq_receiver_country(txns: DataFrame) -> DataFrame:
    return dq_identity(txns, "receiver_identity_no", "receiver_country")


def dq_receiver_name(txns: DataFrame) -> DataFrame:
    return dq_identity(txns, "receiver_identity_no", "receiver_name", " | ", 40)


def dq_branch(txns: DataFrame) -> DataFrame:
    """Customers with several branches in one role."""

    def role(side: str) -> DataFrame:
        number, branch = f"{side}_customer_no", f"{side}_branch"
        return (
            txns.filter(F.col(number).isNotNull() & F.col(branch).isNotNull())
            .select(F.col(number).alias("entity_id"), branch)
            .distinct()
            .groupBy("entity_id")
            .agg(F.count(F.lit(1)).alias("distinct_values"))
            .filter("distinct_values > 1")
        )

    return role("sender").union(role("receiver")).withColumn("values_seen", F.lit("branch mismatch"))


def _fx_deviation() -> Column:
    off = F.abs(F.col("amount_eur") - in_eur(F.col("amount"), F.col("currency")))
    return off.cast("decimal(28,5)") / F.nullif(F.col("amount_eur"), F.lit(0).cast("decimal(18,2)"))


def _fx_violation() -> Column:
    return F.col("amount_eur").isNotNull() & (F.col("amount") > 0) & (_fx_deviation() > 0.01)


def dq_fx(txns: DataFrame) -> DataFrame:
    """EUR amounts more than 1 % off the converted amount, with the deviation in percent."""
    return txns.filter(_fx_violation()).select(
        F.col("txn_id").alias("entity_id"), "currency", "amount", "amount_eur",
        F.round(_fx_deviation() * 100, 2).alias("distinct_values"),
    )


def _lacks_party_field() -> Column:
    return reduce(Column.__or__, [missing(F.col(c)) for c in _PARTY_FIELDS])


def dq_required(txns: DataFrame) -> DataFrame:
    """Payments lacking a party field, with the names of the missing ones."""
    names = F.concat_ws(", ", *[F.when(missing(F.col(c)), F.lit(c)) for c in _PARTY_FIELDS])
    return txns.filter(_lacks_party_field()).select(
        F.col("txn_id").alias("entity_id"), F.lit(1).alias("distinct_values"), names.alias("values_seen")
    )


def _anonymous_sender() -> Column:
    return F.col("sender_customer_no").isNull() & (
        missing(F.col("sender_name")) | missing(F.col("sender_identity_no"))
    )


def dq_external_sender(txns: DataFrame) -> DataFrame:
    return txns.filter(_anonymous_sender()).select(
        F.col("txn_id").alias("entity_id"),
        F.lit(1).alias("distinct_values"),
        F.lit("missing external sender fields").alias("values_seen"),
    )


def dq_scorecard(txns: DataFrame, cap: int | None = None) -> DataFrame:
    """Violations and verdict per catalog rule. Counts are exact unless ``cap`` is given.

    The three row-level rules share one scan.
    """
    entity_checks = {
        "DQ-001": dq_sender_country(txns),
        "DQ-002": dq_sender_name(txns),
        "DQ-003": dq_receiver_country(txns),
        "DQ-004": dq_receiver_name(txns),
        "DQ-005": dq_branch(txns),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule_id"), "n")
        for rule, df in entity_checks.items()
    ]
    row_checks = {"DQ-006": _fx_violation(), "DQ-007": _lacks_party_field(), "DQ-008": _anonymous_sender()}
    counts.append(
        txns.agg(*[F.count_if(c).alias(r) for r, c in row_checks.items()]).unpivot(
            [], list(row_checks), "rule_id", "n"
        )
    )
    found = reduce(DataFrame.unionByName, counts)
    catalog = txns.sparkSession.createDataFrame(
        DQ_RULES, "rule_id string, rule_label string, severity string, category string"
    )
    n = F.col("n") if cap is None else F.least(F.col("n"), F.lit(cap))
    status = F.when(F.col("n").isNull(), "ERROR").when(F.col("n") == 0, "PASS").otherwise("FAIL")
    return catalog.join(found, "rule_id", "left").select(
        "rule_id", "rule_label", "severity", "category", n.alias("violation_count"), status.alias("status")
    )


def schema_tests(df: DataFrame, model: str, spec: dict[str, list]) -> DataFrame:
    """Column tests, one row each with the number of failures.

    ``spec`` maps a column to tests: ``"not_null"``, ``"unique"`` or ``("accepted_values", [...])``.
    """
    checks, uniques = {}, []
    for column, tests in spec.items():
        for test in tests:
            if test == "not_null":
                checks[f"{column}:not_null"] = F.col(column).isNull()
            elif test == "unique":
                uniques.append(column)
            else:
                checks[f"{column}:accepted_values"] = F.col(column).isNotNull() & ~F.col(column).isin(test[1])
    parts = []
    if checks:
        parts.append(
            df.agg(*[F.count_if(c).alias(k) for k, c in checks.items()]).unpivot([], list(checks), "test", "failures")
        )
    for column in uniques:
        repeated = (
            df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        )
        parts.append(
            repeated.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(f"{column}:unique").alias("test"), "failures")
        )
    found = reduce(DataFrame.unionByName, parts)
    spot = F.split("test", ":")
    return found.select(
        F.lit(model).alias("model"),
        spot[0].alias("column_name"),
        spot[1].alias("test_name"),
        "failures",
        F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status"),
    )
