"""The first rows of a table in a total order, for numbers of rows that no single task should hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.operators.alerts import page
from tidewarden.operators.ordered import ordered_scan

#: Up to so many rows a plain limit is used, which sends as many rows of each task to one.
PAGE_ROWS = 10_000

Order = Sequence[tuple[str, bool]]


def _key(df: DataFrame, name: str) -> Column:
    """A value that orders like the column and can be given back as a literal."""
    return F.unix_micros(name) if isinstance(df.schema[name].dataType, T.TimestampType) else F.col(name)


def _sorted(name: str, descending: bool) -> Column:
    return F.desc(name) if descending else F.asc(name)


def _before(key: Column, edge, descending: bool) -> Column:
    """Strictly before ``edge``; nulls come first going up and last going down."""
    if edge is None:
        return key.isNotNull() if descending else F.lit(False)
    if descending:
        return F.coalesce(key > F.lit(edge), F.lit(False))
    return key.isNull() | (key < F.lit(edge))


def first_rows(df: DataFrame, k: int, order: Order, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The ``k`` first rows by ``order``, pairs of a column and whether it descends; together they must be unique.

    The k-th value of the first column is found from the counts of its values, summed up over ranges. Rows before it are
    in, rows after it are out, and only those that tie with it are looked at under the next column. The table itself is
    never sorted or shuffled: it passes one filter at the end. The result has no order.
    """
    if k <= page_rows:
        return page(df, [_sorted(*o) for o in order], k)
    taken, tied, left = F.lit(False), F.lit(True), k
    for name, descending in order:
        key = _key(df, name)
        counts = df.filter(tied).groupBy(key.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        # One value more than needed tells where the rows end.
        summed = ordered_scan(counts, [_sorted("_value", descending)], ["_n"])
        edge = summed.filter(F.col("running__n") >= left).orderBy("idx").limit(1).collect()
        if not edge:
            return df.filter(taken | tied)
        value, upto, n = edge[0]["_value"], edge[0]["running__n"], edge[0]["_n"]
        taken = taken | (tied & _before(key, value, descending))
        tied = tied & key.eqNullSafe(F.lit(value))
        if upto == left:
            return df.filter(taken | tied)
        left -= upto - n
    raise ValueError("the order leaves ties at the last row")
