"""Connected components of an edge table in Spark rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.session import cut_lineage

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Each (node, other) with the least neighbour of the node; combined in the tasks before the shuffle."""
    return edges.join(edges.groupBy("node").agg(F.min("other").alias("least")), "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    seen = _least(both).where(F.col("other") > F.col("node"))
    return seen.select(F.col("other").alias("node"), F.least("least", "node").alias("other")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    seen = _least(edges)
    moved = seen.where(F.col("other") != F.col("least")).select(F.col("other").alias("node"), F.col("least").alias("other"))
    return moved.union(seen.select("node", F.col("least").alias("other"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge and is not itself the root.

    ``edges`` has two columns of one orderable type. Each round halves the depth of the trees at least in
    practice; rounds go on until the edges no longer change, and every round is checkpointed in the shared folder.
    """
    first, second = edges.columns
    a, b = F.col(first), F.col(second)
    known = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    current = cut_lineage(known.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))).first()
        if now == mark or now[0] == 0:
            return current.select("node", F.col("other").alias("root"))
        mark, current = now, cut_lineage(_small_star(_large_star(current)))
    raise RuntimeError("the components did not settle")
