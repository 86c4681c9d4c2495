"""Exact money expressions."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.config import FX_TO_EUR

MONEY = "decimal(18,2)"


def money(col: Column) -> Column:
    """Two-digit decimal, rounded half up."""
    return col.cast(MONEY)


def fx_rate(currency: Column, rates: Mapping[str, Decimal] = FX_TO_EUR) -> Column:
    """Rate to EUR; an unlisted or missing currency counts as EUR."""
    table = F.create_map(*[F.lit(part) for pair in rates.items() for part in (pair[0], Decimal(pair[1]))])
    return F.coalesce(F.try_element_at(table, currency), F.lit(Decimal("1"))).cast("decimal(9,3)")


def in_eur(amount: Column, currency: Column, rates: Mapping[str, Decimal] = FX_TO_EUR) -> Column:
    """Unrounded EUR amount in decimal arithmetic."""
    return money(amount) * fx_rate(currency, rates)


def per_thousand(part: Column, whole: Column) -> Column:
    return F.round(F.lit(1000.0) * part / F.nullif(whole, F.lit(0)), 2)


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 2)
