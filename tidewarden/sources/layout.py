"""Stored payments for lookups of a customer: by day, clustered by sender, with Bloom filters on both parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.calendar import as_col, days_before

#: Columns that lookups compare: row groups without the value are skipped.
PARTIES = ("sender_key", "receiver_customer_no")
#: A lookup reads whole row groups, and of these the pages that can hold its party.
GROUP_ROWS, PAGE_ROWS = 50_000, 2_000


def lay_out(txns: DataFrame, path: str) -> None:
    """Write the payments below ``path``/day=... .

    Ranges of (day, sender, id) make the files, so a day or sender with many payments fills several files and none is one
    task's work. A Bloom filter expects no more different parties than a row group has rows.
    """
    keyed = txns.withColumns({"day": F.to_date("ts"), "sender_key": F.coalesce("sender_customer_no", "sender_id")})
    writer = keyed.repartitionByRange("day", "sender_key", "txn_id").sortWithinPartitions("day", "sender_key", "ts").write
    for column in PARTIES:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(GROUP_ROWS))
    writer = writer.option("parquet.block.row.count.limit", str(GROUP_ROWS)).option("parquet.page.row.count.limit", str(PAGE_ROWS))
    writer.partitionBy("day").parquet(path)


def since(laid: DataFrame, first: Column | str) -> DataFrame:
    """Payments from ``first`` on; only the folders of those days are listed."""
    first = as_col(first)
    return laid.filter((F.col("day") >= first.cast("date")) & (F.col("ts") >= first))


def history(laid: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The trailing days, without an upper bound."""
    return since(laid, days_before(as_of, days))


def sent_by(laid: DataFrame, customer_id: str) -> DataFrame:
    return laid.filter(F.col("sender_key") == customer_id)


def of_customer(laid: DataFrame, customer_id: str) -> DataFrame:
    """Payments with the customer on either side, each once.

    Two scans, because a file skips a row group only by one kind of index at a time: an OR of a column with a dictionary
    and one with a Bloom filter would be read in full.
    """
    received = (F.col("receiver_customer_no") == customer_id) & ~F.col("sender_key").eqNullSafe(F.lit(customer_id))
    return sent_by(laid, customer_id).unionByName(laid.filter(received))
