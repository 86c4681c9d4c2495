"""Supervised triage model on the alert label, and the model run record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.calendar import as_col
from tidewarden.operators import scoring
from tidewarden.operators.features import FEATURE_COLUMNS, assemble
from tidewarden.session import cut_lineage

MIN_SAMPLES = 40
MIN_PER_CLASS = 10
MAX_FOLDS = 5
SEED = 42


@dataclass
class TriageResult:
    trained: bool
    notes: str
    folds: int = 0
    model: GBTClassificationModel | None = None


def _classifier(iterations: int) -> GBTClassifier:
    return GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=iterations, maxDepth=3, stepSize=0.1, seed=SEED
    )


def training_rows(features: DataFrame, label: str = "rule_flagged") -> DataFrame:
    return assemble(features.withColumn("label", F.col(label).cast("double"))).select(
        "customer_id", "label", "features"
    )


def check_balance(rows: DataFrame) -> TriageResult:
    """Whether the labels suffice, and if not, why."""
    counts = rows.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    pos, neg = counts.first()
    # The notes' texts, which are output.
    if pos + neg < MIN_SAMPLES:
        return TriageResult(False, f"insufficient data: {pos + neg} active customers (need >= {MIN_SAMPLES})")
    if min(pos, neg) < MIN_PER_CLASS:
        return TriageResult(
            False, f"supervised skipped: positives={pos}, negatives={neg} (need >= {MIN_PER_CLASS} each)"
        )
    folds = min(MAX_FOLDS, pos, neg)
    notes = f"supervised: {folds}-fold CV on {pos + neg} samples (positives={pos}, negatives={neg})"
    return TriageResult(True, notes, folds)


def _probability(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn("triage_score", vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def triage_fit(rows: DataFrame, iterations: int = 100) -> TriageResult:
    """Fit on all rows if the labels suffice."""
    result = check_balance(rows)
    if result.trained:
        result.model = _classifier(iterations).fit(rows)
    return result


def triage_scores(result: TriageResult, rows: DataFrame) -> DataFrame:
    if not result.trained:
        return rows.select("customer_id", F.lit(None).cast("double").alias("triage_score"))
    return _probability(result.model, rows).select("customer_id", "triage_score")


def oof(rows: DataFrame, k: int, iterations: int = 100) -> DataFrame:
    """Out-of-fold probability of every row, from models that did not see it."""
    folded = cut_lineage(scoring.stratified_folds(rows, "label", k))
    parts = []
    for fold in range(k):
        model = _classifier(iterations).fit(folded.filter(F.col("fold") != fold))
        parts.append(_probability(model, folded.filter(F.col("fold") == fold)))
    return reduce(DataFrame.unionByName, parts).select("customer_id", "label", "fold", "triage_score")


def importances(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Importance per feature, five digits."""
    values = [(n, round(float(v), 5)) for n, v in zip(FEATURE_COLUMNS, model.featureImportances.toArray())]
    return rows.sparkSession.createDataFrame(values, "feature string, importance double")


def _curve_json(curve: DataFrame, x: str, y: str, order: list) -> DataFrame:
    """A curve cut to few points as one JSON object of two lists."""
    cut = scoring.downsample(curve, order)
    pair = F.sort_array(F.collect_list(F.struct("position", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))))
    return cut.agg(pair.alias("p")).select(
        F.to_json(
            F.struct(
                F.transform("p", lambda r: r["x"]).alias(x), F.transform("p", lambda r: r["y"]).alias(y)
            )
        )
    )


def run_record(
    scored: DataFrame,
    evaluated: DataFrame | None,
    result: TriageResult,
    model_version: str,
    trained_at,
    contamination: float = scoring.CONTAMINATION,
) -> DataFrame:
    """Registry row of a training run.

    ``evaluated`` holds out-of-fold scores (triage_score, label); without it the quality columns are null.
    """
    base = scored.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("is_anomaly")).alias("n_anomalies"),
        F.round(F.avg(F.col("rule_flagged").cast("int")), 4).alias("positive_rate"),
    ).select(
        F.lit(model_version).alias("model_version"),
        as_col(trained_at).alias("trained_at"),
        "n_samples",
        F.lit(len(FEATURE_COLUMNS)).alias("n_features"),
        "n_anomalies",
        F.lit(contamination).alias("contamination"),
        F.lit(result.trained).alias("supervised_trained"),
        "positive_rate",
        F.lit(result.notes).alias("notes"),
    )
    names = ["roc_auc", "pr_auc", "precision_score", "recall_score", "f1_score"]
    if not result.trained or evaluated is None:
        return base.withColumns(
            {
                **{n: F.lit(None).cast("double") for n in names},
                **{n: F.lit(None).cast("string") for n in ("roc_curve", "pr_curve", "feature_importance")},
            }
        )
    steps = scoring.confusion_steps(evaluated.withColumn("hit", F.col("label") == 1), "triage_score", "hit")
    curve = scoring.pr_curve(steps)
    best = scoring.best_threshold(curve)
    roc = _curve_json(scoring.roc_curve(steps), "fpr", "tpr", [F.asc("fpr"), F.asc("tpr")])
    prc = _curve_json(curve, "recall", "precision", [F.asc_nulls_last("threshold")])
    weights = (
        importances(result.model, scored)
        .agg(F.sort_array(F.collect_list(F.struct("feature", "importance"))).alias("w"))
        .select(F.to_json(F.map_from_entries("w")))
        if result.model is not None
        else None
    )
    return base.withColumns(
        {
            "roc_auc": scoring.roc_auc(steps).scalar(),
            "pr_auc": scoring.average_precision(steps).scalar(),
            "precision_score": best.select("precision_score").scalar(),
            "recall_score": best.select("recall_score").scalar(),
            "f1_score": best.select("f1_score").scalar(),
            "roc_curve": roc.scalar(),
            "pr_curve": prc.scalar(),
            "feature_importance": F.lit(None).cast("string") if weights is None else weights.scalar(),
        }
    )
