"""Identifiers, masking and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def hash_id(col: Column) -> Column:
    """First 16 hex digits of SHA-256; a missing or blank value is a dash."""
    text = col.cast("string")
    return F.when(
        F.coalesce(F.length(F.trim(text)), F.lit(0)) > 0, F.substring(F.sha2(text, 256), 1, 16)
    ).otherwise(F.lit(DASH))


def mask_identity(col: Column) -> Column:
    """Keep three leading and two trailing characters of an identity number."""
    return (
        F.when(col.isNull(), F.lit(DASH))
        .when(F.length(col) <= 4, F.lit("****"))
        .otherwise(F.concat(F.substring(col, 1, 3), F.lit("****"), F.right(col, F.lit(2))))
    )


def blank_to(col: Column, value: str) -> Column:
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", F.lit(value)).otherwise(col)


def missing(col: Column) -> Column:
    """True for null and for the empty string."""
    return col.isNull() | (col == "")


def bucket_of(col: Column, values: list[str]) -> Column:
    """A stable choice out of ``values`` by the hash of a key."""
    spot = F.pmod(F.xxhash64(col), F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), spot)


def fixed(col: Column, digits: int) -> Column:
    """A number with fixed decimals, halves to even, no grouping."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", col.cast("double"), F.lit(pattern))


def human_bytes(col: Column) -> Column:
    """``512 B``, ``1.5 KB`` … up to petabytes, one decimal place above bytes."""
    size = col.cast("double")
    text = F.when(size < 1024, F.concat(fixed(size, 0), F.lit(" B")))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        scaled = size / F.lit(float(1024**power))
        text = text.when(scaled < 1024, F.concat(fixed(scaled, 1), F.lit(" " + unit)))
    petabytes = fixed(size / F.lit(float(1024**5)), 1)
    return F.when(size.isNull(), F.lit(DASH)).otherwise(
        text.otherwise(F.concat(petabytes, F.lit(" PB")))
    )


def customer_number(col: Column) -> Column:
    """The digits of a customer id as a number."""
    return F.regexp_replace(col, r"\D", "").try_cast("bigint")
