"""Isolation forest (Liu, Ting, Zhou 2008): trees are grown and scored by Spark tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.operators.features import FEATURE_COLUMNS

_NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth int, size int"
_OVERSAMPLE = 1.5


def _path_rest(size) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``size`` rows."""
    n = np.asarray(size, dtype="float64")
    safe = np.maximum(n, 2.0)
    rest = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, rest, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, tree: int, seed: int, max_depth: int) -> pd.DataFrame:
    rng = np.random.default_rng((seed, tree))
    nodes: list[tuple] = []
    todo = [(np.arange(len(rows)), 0, -1, 0)]
    while todo:
        members, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = me
        low, high = rows[members].min(axis=0), rows[members].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(members) <= 1 or len(usable) == 0:
            nodes.append([tree, me, -1, 0.0, -1, -1, depth, len(members)])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append([tree, me, feature, cut, -1, -1, depth, len(members)])
        goes_left = rows[members, feature] <= cut
        todo.append((members[goes_left], depth + 1, me, 0))
        todo.append((members[~goes_left], depth + 1, me, 1))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth", "size"])


@dataclass
class IsolationForest:
    """Unsupervised anomaly scores; a higher score is more anomalous."""

    trees: int = 200
    subsample: int = 256
    seed: int = 42
    key: str = "customer_id"
    columns: list[str] = field(default_factory=lambda: list(FEATURE_COLUMNS))
    nodes: pd.DataFrame | None = None
    rows_per_tree: int = 0

    def tree_rows(self, matrix: DataFrame) -> DataFrame:
        """(tree, row) samples without replacement per tree, chosen by hash among all rows.

        Each tree draws by hashes of its own: every row can be drawn for every tree, whatever the size of the table.
        """
        total = matrix.count()
        top = float(2**63)
        key = F.col(self.key)
        share = min(1.0, _OVERSAMPLE * self.subsample / max(total, 1))
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(self.trees - 1)),
            lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(self.seed), t, key).alias("draw")),
        )
        chosen = F.filter(draws, lambda d: (d["draw"] / F.lit(top) + 1) / 2 <= share)
        drawn = matrix.select(self.key, *self.columns, F.inline(chosen))
        first = Window.partitionBy("tree").orderBy("draw", self.key)
        return (
            drawn.withColumn("_rn", F.row_number().over(first))
            .filter(F.col("_rn") <= self.subsample)
            .drop("_rn", "draw")
        )

    def fit(self, matrix: DataFrame) -> IsolationForest:
        seed, columns = self.seed, self.columns
        depth = max(1, math.ceil(math.log2(max(self.subsample, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            return _grow(pdf.sort_values(self_key)[columns].to_numpy("float64"), int(pdf["tree"].iloc[0]), seed, depth)

        self_key = self.key
        forest = self.tree_rows(matrix).groupBy("tree").applyInPandas(grow, _NODE_SCHEMA)
        # At most trees * (2 * subsample - 1) small rows, whatever the size of the data.
        self.nodes = forest.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        self.rows_per_tree = int(self.nodes.loc[self.nodes["node"] == 0, "size"].max()) if len(self.nodes) else 0
        return self

    def score(self, matrix: DataFrame, output: str = "raw_score") -> DataFrame:
        """Add the anomaly score 2 ** (-mean path / expected path)."""
        if self.nodes is None:
            raise ValueError("fit the forest first")
        nodes = self.nodes
        starts = nodes.index[nodes["node"] == 0].to_numpy()
        tree_start = np.repeat(starts, np.diff(np.append(starts, len(nodes))))
        is_leaf = nodes["feature"].to_numpy() < 0
        here = np.arange(len(nodes))
        forest = {
            "roots": starts,
            "feature": np.where(is_leaf, 0, nodes["feature"].to_numpy()),
            "cut": nodes["cut"].to_numpy(),
            "left": np.where(is_leaf, here, nodes["left"].to_numpy() + tree_start),
            "right": np.where(is_leaf, here, nodes["right"].to_numpy() + tree_start),
            "length": nodes["depth"].to_numpy() + _path_rest(nodes["size"].to_numpy()),
            "steps": int(nodes["depth"].max()) if len(nodes) else 0,
            "expected": float(_path_rest(max(self.rows_per_tree, 2))),
        }
        shared = matrix.sparkSession.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def anomaly(*parts: pd.Series) -> pd.Series:
            f = shared.value
            x = np.column_stack([p.to_numpy("float64") for p in parts])
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for root in f["roots"]:
                at = np.full(len(x), root)
                for _ in range(f["steps"]):
                    goes_left = x[rows, f["feature"][at]] <= f["cut"][at]
                    at = np.where(goes_left, f["left"][at], f["right"][at])
                total += f["length"][at]
            return pd.Series(np.exp2(-(total / max(len(f["roots"]), 1)) / f["expected"]))

        return matrix.withColumn(output, anomaly(*[F.col(c) for c in self.columns]))
