"""Scans: stored tables, history, wire records, table listings."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.calendar import as_col, days_before
from tidewarden.sources.schema import WIRE_SCHEMA


def read_table(
    spark: SparkSession,
    base: str,
    name: str,
    columns: Sequence[str] | None = None,
    predicate: Column | str | None = None,
) -> DataFrame:
    """A parquet table with projection and filter; Catalyst pushes both into the scan."""
    df = spark.read.parquet(os.path.join(base, f"{name}.parquet"))
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """A database table; with a partition column it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def history(txns: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Transactions of the trailing days; no upper bound, so late clocks are kept."""
    return txns.filter(F.col("ts") >= days_before(as_of, days))


def _decoded(raw: DataFrame, column: str) -> DataFrame:
    parsed = F.from_json(F.col(column).cast("string"), WIRE_SCHEMA)
    return raw.withColumn("payment", parsed)


def parse_txn_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Decode wire records and keep those that carry a transaction id."""
    return _decoded(raw, column).filter(F.col("payment.txn_id").isNotNull()).select("payment.*")


def split_bad_records(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good payments, raw records without a usable transaction id)."""
    decoded = _decoded(raw, column)
    good = decoded.filter(F.col("payment.txn_id").isNotNull()).select("payment.*")
    bad = decoded.filter(F.col("payment.txn_id").isNull()).drop("payment")
    return good, bad


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact number of rows per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def schema_overview(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column, type and position of every column."""
    rows = [
        (name, column, kind, position)
        for name, df in sorted(tables.items())
        for position, (column, kind) in enumerate(df.dtypes, start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, ordinal_position int"
    )


def as_wire_json(payments: DataFrame) -> DataFrame:
    """Payments as the JSON text a producer would send."""
    return payments.select(F.to_json(F.struct(*payments.columns)).alias("value"))


def stale_before(as_of, days: int) -> Column:
    return as_col(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
