"""Distinct counterparties that roll up: a mergeable sketch per customer and day, and the exact way beside it.

A sketch takes a bounded number of bytes however many counterparties a customer has, and the sketches of any days merge to
that of the whole span. ``ERROR`` of ``LG_K`` is the relative standard error; small sets are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.calendar import as_col
from tidewarden.operators.windows import transfer_facts

#: 2**LG_K registers of at most a byte each.
LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def daily_sketches(txns: DataFrame) -> DataFrame:
    """(customer_id, day, receivers): one sketch per sender and day, built in every task and merged by the shuffle."""
    facts = transfer_facts(txns).filter(F.col("receiver_id").isNotNull())
    return facts.groupBy(F.col("sender_id").alias("customer_id"), F.to_date("event_ts").alias("day")).agg(
        F.hll_sketch_agg("receiver_id", LG_K).alias("receivers")
    )


def receivers_between(daily: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """(customer_id, receivers): estimated distinct receivers over the days ``first`` to ``last``, from the sketches."""
    days = F.col("day").between(as_col(first).cast("date"), as_col(last).cast("date"))
    return daily.filter(days).groupBy("customer_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("receivers")).alias("receivers")
    )


def exact_between(txns: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """The same, counted: two steps grouped by receiver first, so that no list is built."""
    day = F.to_date("ts")
    inside = txns.filter(day.between(as_col(first).cast("date"), as_col(last).cast("date")))
    return transfer_facts(inside).groupBy(F.col("sender_id").alias("customer_id")).agg(F.count_distinct("receiver_id").alias("receivers"))


def within_error(estimate: Column, exact: Column, deviations: float = 4.0) -> Column:
    """Whether the estimate lies within so many standard errors, or one, of the exact count."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * (deviations * ERROR))
