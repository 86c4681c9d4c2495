"""Positions and running sums over a whole table in one total order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.session import cut_lineage


def ordered_scan(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """Add ``idx`` (0-based position) and ``running_<c>`` (inclusive sum) for each column in ``sums``.

    Rows are range-partitioned and sorted by ``order`` (which must be total), numbered within each range,
    and the totals of the ranges before are added. The ranged rows are checkpointed: they are read twice,
    and both reads must see the same ranges even if an executor is lost.
    """
    # Row numbers of ``monotonically_increasing_id`` start at zero in each partition below bit 33.
    spot = F.monotonically_increasing_id()
    ranged = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_range": F.shiftright(spot, 33), "_at": spot.bitwiseAND(F.lit((1 << 33) - 1))})
    )
    local = ranged
    if sums:
        upto = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        local = ranged.withColumns({f"_sum_{c}": F.sum(c).over(upto) for c in sums})
    totals = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_total_{c}") for c in sums]
    )
    # One row per range: never more rows than shuffle partitions, so this side may be broadcast.
    earlier = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
    )
    return local.join(F.broadcast(offsets), "_range").select(
        *df.columns,
        (F.col("_before") + F.col("_at")).alias("idx"),
        *[(F.col(f"_before_{c}") + F.col(f"_sum_{c}")).alias(f"running_{c}") for c in sums],
    )
