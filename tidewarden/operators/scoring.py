"""Score normalisation, ranking, curves and comparisons of rules with models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.alerts import attach, page
from tidewarden.operators.ordered import ordered_scan

CONTAMINATION = 0.05
CURVE_POINTS = 200


def normalize(df: DataFrame, column: str, output: str = "anomaly_score") -> DataFrame:
    """Min-max to 0..1; a range below 1e-12 gives 0."""
    ends = df.select(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = ends.getField("low"), ends.getField("high")
    spread = high - low
    value = F.when(spread < 1e-12, F.lit(0.0)).otherwise((F.col(column) - low) / spread)
    return df.withColumn(output, value)


def anomaly_rank(df: DataFrame, score: str = "anomaly_score", key: str = "customer_id") -> DataFrame:
    """Rank 1.. by score, highest first, ties by key."""
    ranked = ordered_scan(df, [F.desc(score), F.asc(key)])
    return ranked.withColumn("anomaly_rank", F.col("idx") + 1).drop("idx")


def flag_anomalies(df: DataFrame, raw: str, contamination: float = CONTAMINATION, key: str = "customer_id") -> DataFrame:
    """Add rank and ``is_anomaly``: above the interpolated quantile that leaves ``contamination`` over it."""
    ranked = ordered_scan(df, [F.desc(raw), F.asc(key)])
    n = ranked.select(F.count(F.lit(1))).scalar()
    at = (n - 1) * F.lit(contamination)
    low, high = F.floor(at), F.ceil(at)
    above = ranked.filter(F.col("idx") == low).select(F.max(raw)).scalar()
    below = ranked.filter(F.col("idx") == high).select(F.max(raw)).scalar()
    threshold = above + (below - above) * (at - low)
    return (
        ranked.withColumn("is_anomaly", F.col(raw) > threshold)
        .withColumn("anomaly_rank", F.col("idx") + 1)
        .drop("idx")
    )


def confusion_steps(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score, highest first: positives and negatives at it and down to it."""
    per_score = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    steps = ordered_scan(per_score, [F.desc("threshold")], ["pos", "neg"])
    return steps.withColumnsRenamed({"running_pos": "tp", "running_neg": "fp"})


def _totals(steps: DataFrame) -> tuple[Column, Column]:
    return steps.select(F.sum("pos")).scalar(), steps.select(F.sum("neg")).scalar()


def roc_auc(steps: DataFrame) -> DataFrame:
    """Area under the ROC curve: the chance that a positive outranks a negative, ties half."""
    wins = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")))
    area = wins / (F.lit(2.0) * F.sum("pos") * F.sum("neg"))
    return steps.agg(F.round(area, 4).alias("roc_auc"))


def average_precision(steps: DataFrame) -> DataFrame:
    """Step-wise average precision (no interpolation)."""
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.agg(F.round(F.sum(step) / F.sum("pos"), 4).alias("pr_auc"))


def roc_curve(steps: DataFrame) -> DataFrame:
    """Points from (0, 0) on; inner points on a straight line are left out.

    A point is straight when the next step has the same positives and negatives; the next step is found
    by an equi join on the position.
    """
    positives, negatives = _totals(steps)
    ahead = steps.select((F.col("idx") - 1).alias("idx"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    bends = (
        (F.col("idx") == 0)
        | F.col("next_pos").isNull()
        | (F.col("next_pos") != F.col("pos"))
        | (F.col("next_neg") != F.col("neg"))
    )
    inner = (
        steps.join(ahead, "idx", "left")
        .filter(bends)
        .select(
            (F.col("fp") / negatives).alias("fpr"), (F.col("tp") / positives).alias("tpr"), "threshold"
        )
    )
    spark = steps.sparkSession
    origin = spark.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    return origin.unionByName(inner)


def pr_curve(steps: DataFrame) -> DataFrame:
    """Precision and recall per threshold, and the closing point (precision 1, recall 0)."""
    positives, _ = _totals(steps)
    points = steps.select(
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / positives).alias("recall"),
        "threshold",
    )
    closing = steps.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(closing)


def downsample(df: DataFrame, order: list[Column], n: int = CURVE_POINTS) -> DataFrame:
    """At most ``n`` rows at evenly spaced positions, first and last included."""
    ranked = ordered_scan(df, order)
    rows = df.select(F.count(F.lit(1))).scalar()
    # Position p is taken when p = floor(i * (rows - 1) / (n - 1)) for some i.
    i = F.ceil(F.col("idx") * F.lit(n - 1) / (rows - 1))
    taken = F.floor(i * (rows - 1) / F.lit(n - 1)) == F.col("idx")
    return ranked.filter((rows <= n) | taken).withColumnRenamed("idx", "position")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold with the best F1, the lowest on a tie, and the scores there."""
    f1 = F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12), 12)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("low"), "precision", "recall"))
    top = curve.filter(F.col("threshold").isNotNull()).agg(best.alias("b"))
    return top.select(
        (-F.col("b.low")).alias("threshold"),
        F.round("b.precision", 4).alias("precision_score"),
        F.round("b.recall", 4).alias("recall_score"),
        F.round("b.f1", 4).alias("f1_score"),
    )


def score_snapshot(scored: DataFrame, model_version: str, triage: DataFrame | None = None) -> DataFrame:
    """The score table: one row per scored customer and model version."""
    df = scored if triage is None else scored.join(triage, "customer_id", "left")
    triage_score = F.lit(None).cast("double") if triage is None else F.round("triage_score", 5)
    return df.select(
        "customer_id",
        F.lit(model_version).alias("model_version"),
        F.round("anomaly_score", 5).alias("anomaly_score"),
        "anomaly_rank",
        "is_anomaly",
        triage_score.alias("triage_score"),
        "rule_flagged",
        F.col("txn_count_30d").cast("int").alias("txn_count_30d"),
        "volume_30d",
        F.col("distinct_receivers_30d").cast("int").alias("distinct_receivers_30d"),
        "max_txn_30d",
        "kyc_risk_score",
    )


def ml_overlap(scores: DataFrame) -> DataFrame:
    """Agreement of rules and anomaly model in one row."""
    ml, rule = F.col("is_anomaly"), F.col("rule_flagged")
    return scores.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ml & rule).alias("both"),
        F.count_if(ml & ~rule).alias("ml_only"),
        F.count_if(~ml & rule).alias("rule_only"),
        F.count_if(~ml & ~rule).alias("neither"),
    )


def ml_overlap_groups(scores: DataFrame) -> DataFrame:
    return scores.groupBy("rule_flagged", "is_anomaly").agg(F.count(F.lit(1)).alias("customers"))


def crosstab(scores: DataFrame) -> DataFrame:
    """Rule verdict by model verdict, one column per model verdict."""
    named = scores.select("rule_flagged", F.when(F.col("is_anomaly"), "anomaly").otherwise("normal").alias("verdict"))
    return named.groupBy("rule_flagged").pivot("verdict", ["normal", "anomaly"]).count().fillna(0)


def top_anomalies(scores: DataFrame, customers: DataFrame, by: str = "anomaly_score", limit: int = 20) -> DataFrame:
    columns = [
        "customer_id", "anomaly_score", "anomaly_rank", "is_anomaly", "triage_score", "rule_flagged",
        "txn_count_30d", "volume_30d", "distinct_receivers_30d", "max_txn_30d", "kyc_risk_score",
    ]
    order = "triage_score" if by == "triage_score" else "anomaly_score"
    top = page(scores.select(*columns), [F.desc_nulls_last(order), F.asc("customer_id")], limit)
    return attach(top, customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")


def ml_only(scores: DataFrame, limit: int = 20) -> DataFrame:
    hit = F.col("is_anomaly") & ~F.col("rule_flagged")
    columns = ["customer_id", "anomaly_score", "triage_score", "txn_count_30d", "volume_30d"]
    return page(scores.filter(hit).select(*columns), [F.desc("anomaly_score"), F.asc("customer_id")], limit)


def score_histogram(scores: DataFrame, bins: int = 40) -> DataFrame:
    """Customers per score bin and rule verdict; a score of 1 falls in the last bin."""
    spot = F.least(F.floor(F.col("anomaly_score") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(spot.alias("bin"), "rule_flagged").agg(F.count(F.lit(1)).alias("customers"))


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return page(runs, [F.desc("trained_at"), F.desc("model_version")], limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs, 1)


def stratified_folds(df: DataFrame, label: str, k: int, key: str = "customer_id", seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1 so that each class is spread evenly over the folds.

    Rows are ordered by class and then by a hash; neighbours get different folds.
    """
    order = [F.asc(label), F.xxhash64(F.lit(seed), key).asc(), F.asc(key)]
    return ordered_scan(df, order).withColumn("fold", (F.col("idx") % k).cast("int")).drop("idx")


def stratified_split(
    df: DataFrame, label: str, test_fraction: float = 0.3, key: str = "customer_id", seed: int = 42
) -> DataFrame:
    """Add ``is_test`` with the same share of each class."""
    order = [F.asc(label), F.xxhash64(F.lit(seed), key).asc(), F.asc(key)]
    ranked = ordered_scan(df, order)
    sizes = ranked.groupBy(label).agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_size"))
    spot = F.col("idx") - F.col("_first")
    # Two rows, one per class.
    return (
        ranked.join(F.broadcast(sizes), label)
        .withColumn("is_test", spot < F.round(F.col("_size") * test_fraction))
        .drop("idx", "_first", "_size")
    )
