"""Centroid clustering of integer vectors, with Ptolemaic lower bounds from pivots.

Every vector is a row of whole numbers, so sums, means and squared distances are exact and the result does not
depend on how Spark deals the rows. Euclidean distance obeys Ptolemy's inequality: for a vector x, a centroid c and
two pivots p, s,

    d(x, c) * d(p, s)  >=  | d(x, p) * d(c, s) - d(x, s) * d(c, p) |.

The pivots are the centroids after ``WARM`` rounds without bounds, since a bound is sharp only where a pivot lies near
the vector or the centroid. From then on they are fixed: the distances of each vector to them are computed once and
stored beside it, and those of a centroid once per round. Over all pivot pairs this bounds each distance from below without looking at the vector.
Each vector is measured exactly against the centroid of least bound; a centroid whose bound is above that distance
cannot be nearest and goes, and the survivors are measured exactly. The bounds are lowered by more than their
rounding error, so a true nearest centroid, or one that ties with it, always survives.

A round is one scan: every task adds its vectors up per centroid, and the driver receives ``k`` sums of ``dims``
numbers. Nothing is shuffled but these sums, so a cluster with all the rows costs what any other does.

Defined cases: a null, wrongly sized, null-holding or non-finite vector is left out. Repeated rows count each time.
A null id seeds as the empty id; equal seeds are ordered by their components. Fewer vectors than centroids give one
centroid each, and no vector gives no row. Components of 2**17 or more in size would not fit exact 64-bit distances
and stop the job with a message. Other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import stored

DIMS, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, 3
#: Rounds before the pivots are taken, and how many are taken.
WARM, PIVOTS = 2, 8
#: Components beyond this could overflow a squared distance in 64 bits.
LARGEST = 1 << 17
#: Rows measured at a time inside a task.
ROWS = 4096
#: Relative error granted to each float step of a bound; several times what the steps can lose.
SLACK = 2.0**-48

_SUMS = "cluster int, part int, total bigint"


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the complete vectors, each component ``floor(scale * x)``."""
    value = lambda x: x.cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf"))
    kept = df.where((F.size(vector) == dims) & F.forall(vector, finite))
    fits = F.forall(vector, lambda x: F.abs(value(x)) < float(LARGEST))
    message = F.lit(f"a vector has a component of {LARGEST} or more")
    whole = F.transform(vector, lambda x: F.floor(value(x) * scale).cast("bigint"))
    return kept.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(fits, whole).otherwise(F.raise_error(message)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows of ``points``, each the farthest from those before it; the first is row 0."""
    chosen = [0]
    near = square(points, points[0])
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, square(points, points[chosen[-1]]))
    return points[chosen]


def square(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to one point."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``to_pivots``, the exact squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = matrix(part.column(1), pivots.shape[1])
                cached = np.stack([square(x, p) for p in pivots], axis=1)
                edges = pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32())
                column = pa.ListArray.from_arrays(edges, pa.array(cached.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], ["vec_id", "v", "to_pivots"])

    return vectors.mapInArrow(run, "vec_id bigint, v array<bigint>, to_pivots array<bigint>")


@dataclass(frozen=True)
class Pivots:
    """The pivots' mutual distances, and the centroids' distances to them for one round."""

    pairs: list[tuple[int, int, float]]
    of_centroids: np.ndarray

    @classmethod
    def measure(cls, pivots: np.ndarray, centroids: np.ndarray) -> Pivots:
        between = np.sqrt([square(pivots, p).astype(float) for p in pivots])
        pairs = [(i, j, float(between[i, j])) for i, j in combinations(range(len(pivots)), 2)]
        return cls(pairs, np.sqrt([square(pivots, c).astype(float) for c in centroids]))

    def lower_squares(self, to_pivots: np.ndarray) -> np.ndarray:
        """For each vector and centroid a number that is never above their squared distance."""
        x, c = np.sqrt(to_pivots.astype(float)), self.of_centroids
        best = np.zeros((len(x), len(c)))
        for i, j, between in self.pairs:
            one, two = x[:, i, None] * c[None, :, j], x[:, j, None] * c[None, :, i]
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / between, out=best)
        return best * best * (1 - SLACK)


def nearest(x: np.ndarray, centroids: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid and exact squared distance of each vector, and how many distances were computed."""
    n = len(x)
    cluster = floors.argmin(axis=1).astype(np.int64)
    gap = x - centroids[cluster]
    best = np.einsum("ij,ij->i", gap, gap)
    left = floors <= best[:, None]
    left[np.arange(n), cluster] = False
    measured = n
    for c in range(len(centroids)):
        # The best so far only falls, so a centroid may drop out while others are measured.
        rows = np.flatnonzero(left[:, c] & (floors[:, c] <= best))
        if not len(rows):
            continue
        measured += len(rows)
        d = square(x[rows], centroids[c])
        closer = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = d[closer], c
    return cluster, best, measured


def _parts(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray | None):
    around = None if pivots is None else Pivots.measure(pivots, centroids)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = matrix(part.column(1), centroids.shape[1])
            if around is None:
                floors = np.zeros((len(x), len(centroids)))
            else:
                floors = around.lower_squares(matrix(part.column(2), len(pivots)))
            yield (part, x, *nearest(x, centroids, floors))


def moved(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """One round: every vector to its nearest centroid, and these to the floor of the mean of their vectors.

    Without pivots, ``cached`` needs no distances to them and every centroid is measured.
    """
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)
        for _, x, cluster, _, _ in _parts(batches, centroids, pivots):
            for c in range(k):
                rows = cluster == c
                sums[c, :dims] += x[rows].sum(axis=0)
                sums[c, dims] += rows.sum()
        cluster, part = np.divmod(np.arange(sums.size), dims + 1)
        columns = [pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(sums.reshape(-1), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "part", "total"])

    sums = cached.mapInArrow(run, _SUMS).groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {(r["cluster"], r["part"]): int(r["total"]) for r in sums.collect()}
    result = centroids.copy()
    for c in range(k):
        count = totals.get((c, dims), 0)
        if count:
            result[c] = [totals[c, i] // count for i in range(dims)]
    return result


def assigned(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, measured): ``measured`` of a row is the share of its block's exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, cluster, best, measured in _parts(batches, centroids, pivots):
            columns = [
                part.column(0), pa.array(cluster, pa.int32()), pa.array(best, pa.int64()),
                pa.array(np.full(len(x), measured / len(x)), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "measured"])

    return cached.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, measured double")


@dataclass(frozen=True)
class Clusters:
    """The final centroids and the stored rows (vec_id, cluster, distance, measured)."""

    centroids: np.ndarray
    rows: DataFrame


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, n_pivots: int = PIVOTS) -> Clusters:
    """Cluster rows (vec_id, v) of whole numbers; ``vectors`` is read from a stored table in every round."""
    vectors = stored(vectors, "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clusters(centroids, vectors.select("vec_id", *(F.lit(0).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("measured", "double")))))
    cached, pivots = vectors, None
    for number in range(rounds + 1):
        if number == min(WARM, rounds):
            pivots = spread(centroids, n_pivots)
            cached = stored(with_pivots(vectors, pivots), "pivot-distances")
        if number == rounds:
            break
        after = moved(cached, centroids, pivots)
        if pivots is not None and np.array_equal(after, centroids):
            break  # all further rounds would repeat this one
        centroids = after
    return Clusters(centroids, stored(assigned(cached, centroids, pivots), "clusters"))


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def _by_cluster(values: dict[int, object], kind: str) -> Column:
    pairs = [F.lit(x) for c, v in values.items() for x in (c, v)]
    return F.try_element_at(F.create_map(*pairs), F.col("cluster")).cast(kind) if pairs else F.lit(None).cast(kind)


def clustered(embeddings: DataFrame) -> DataFrame:
    """Every complete vector with its cluster, exact squared distance, both inertias and the centroid's digest."""
    found = cluster(whole_vectors(embeddings))
    inertia = {r["cluster"]: int(r["total"]) for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = {c: centroid_digest(v) for c, v in enumerate(found.centroids)}
    return found.rows.select(
        "vec_id", "cluster", "distance",
        _by_cluster(inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        _by_cluster(digests, "string").alias("centroid_sha256"),
    )


def _oracle() -> str:
    """The same rounds as SQL over all vectors and centroids, without bounds."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS}))""",
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""d{n} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := CAST(d AS BIGINT), c := c)) AS best
  FROM (SELECT x.rid, c.c, {gap} AS d FROM kept x, c{n} c) GROUP BY rid)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v
  FROM c{n} c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT b.best.c AS c, i, CAST(sum(x.v[i]) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n
          FROM d{n} b JOIN kept x USING (rid), range(1, {DIMS + 1}) t(i) GROUP BY ALL)
    GROUP BY c) m ON m.c = c.c)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT x.vec_id, CAST(b.best.c AS INTEGER) AS cluster, b.best.d AS distance,
  CAST(sum(b.best.d) OVER (PARTITION BY b.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept x JOIN d{ROUNDS} b USING (rid) JOIN c{ROUNDS} c ON c.c = b.best.c"""


ORACLE = _oracle()
