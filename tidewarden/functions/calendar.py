"""Calendar-aligned windows and time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_TYPES = ["daily", "weekly", "biweekly", "monthly"]

# Fixed value: first day of a biweekly period.
BIWEEKLY_ANCHOR = "2026-01-01"


def as_col(value: Column | dt.datetime | str) -> Column:
    """An instant as a timestamp column."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def window_start(ts: Column, window_type: str) -> Column:
    """Start of the daily, weekly (Monday), biweekly or monthly window that holds ``ts``."""
    if window_type == "daily":
        return F.date_trunc("day", ts)
    if window_type == "weekly":
        return F.date_trunc("week", ts)
    if window_type == "monthly":
        return F.date_trunc("month", ts)
    if window_type == "biweekly":
        day = F.to_date(ts)
        into = F.pmod(F.datediff(day, F.lit(BIWEEKLY_ANCHOR).cast("date")), F.lit(14))
        return F.date_sub(day, into).cast("timestamp")
    raise ValueError(f"unknown window type {window_type!r}")


def window_codes(ts: Column) -> Column:
    """All windows that hold ``ts`` as an array of integers: four times the start day plus the type.

    A compact grouping key for the moment between splitting payments by window and naming the windows.
    """
    day = F.unix_date(F.to_date(ts))
    anchor = F.unix_date(F.lit(BIWEEKLY_ANCHOR).cast("date"))
    starts = {
        "daily": day,
        "weekly": day - F.weekday(F.to_date(ts)),
        "biweekly": day - F.pmod(day - anchor, F.lit(14)),
        "monthly": F.unix_date(F.trunc(F.to_date(ts), "month")),
    }
    return F.array(*[starts[w] * 4 + i for i, w in enumerate(WINDOW_TYPES)])


def code_type(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WINDOW_TYPES]), F.pmod(code, F.lit(4)) + 1)


def code_start(code: Column) -> Column:
    return F.date_from_unix_date(F.floor(code / 4).cast("int")).cast("timestamp")


def days_before(as_of, days: int) -> Column:
    return as_col(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def hours_before(as_of, hours: int) -> Column:
    return as_col(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")


def minutes_before(as_of, minutes: int) -> Column:
    return as_col(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def midnight(as_of) -> Column:
    return F.date_trunc("day", as_col(as_of))


def age_seconds(ts: Column, as_of) -> Column:
    """Whole seconds from ``ts`` to ``as_of``."""
    return F.unix_timestamp(as_col(as_of)) - F.unix_timestamp(ts)


def relative_age(ts: Column, as_of) -> Column:
    """``5m ago``, ``3h ago`` or ``2d ago``; a missing time is a dash, a future one ``0m ago``."""
    micros = F.unix_micros(as_col(as_of)) - F.unix_micros(ts)
    minutes = F.greatest(F.floor(micros / F.lit(60_000_000)), F.lit(0))
    return (
        F.when(ts.isNull(), F.lit("—"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )
