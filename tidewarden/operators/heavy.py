"""Joins on keys of which a few hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 0.02
MOST_KEYS = 100
#: Items the sketch tracks; an estimate is too high by at most rows / (TRACKED / 3).
TRACKED = 10_000
SALTS = 32


def heavy_keys(df: DataFrame, key: str, share: float = SHARE, most: int = MOST_KEYS) -> list:
    """Keys that may hold at least ``share`` of the rows: one pass with a sketch per task, no shuffle of rows.

    The sketch never estimates too low by more than it estimates too high, so every key well above ``share`` is found;
    at most ``most`` keys come to the driver. A key too many costs a few copies and never changes a join.
    """
    if share * most < 1:
        raise ValueError("share * most must reach 1, or heavy keys could be left out")
    found = df.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {int(most)}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return sorted(t["item"] for t in found["top"] or [] if t["count"] >= share * found["n"])


def _salt(columns: Sequence[str], salts: int) -> Column:
    """Follows from the row itself, so that a task that runs again deals its rows alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(
    large: DataFrame, other: DataFrame, large_key: str, other_key: str, heavy: Sequence, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join in which the rows of a heavy key of ``large`` are dealt to ``salts`` groups and its partners copied to each.

    Rows of other keys are not copied. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti`` seen from ``large``.
    Rows of ``large`` that are equal in all columns go to one group. Both key columns stay.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    if not heavy:
        return large.join(other, large[large_key] == other[other_key], how)
    if {"_salt", "_salts"} & {*large.columns, *other.columns}:
        raise ValueError("a column _salt or _salts exists already")
    is_heavy = lambda c: F.coalesce(F.col(c).isin(list(heavy)), F.lit(False))
    dealt = large.withColumn("_salt", F.when(is_heavy(large_key), _salt(large.columns, salts)).otherwise(0))
    every = F.when(is_heavy(other_key), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = other.withColumn("_salts", F.explode(every))
    joined = dealt.join(copied, (dealt[large_key] == copied[other_key]) & (dealt["_salt"] == copied["_salts"]), how)
    return joined.drop("_salt", "_salts")
