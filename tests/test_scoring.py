import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewarden.operators import features, iforest, scoring, triage
from tidewarden.operators.ordered import ordered_scan


def test_ordered_scan_matches_a_global_sort(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 101).alias("v"), F.lit(1).alias("one"))
    got = ordered_scan(df.repartition(7), [F.desc("v"), F.asc("id")], ["one", "v"]).orderBy("idx").collect()
    expected = sorted(((i * 7919 % 101, i) for i in range(1000)), key=lambda p: (-p[0], p[1]))
    assert [(r.v, r.id) for r in got] == expected
    assert [r.idx for r in got] == list(range(1000))
    assert [r.running_one for r in got] == list(range(1, 1001))
    assert [r.running_v for r in got] == list(np.cumsum([v for v, _ in expected]))


def test_ordered_scan_with_one_value_for_a_third_of_the_rows(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    got = ordered_scan(df, [F.asc("v"), F.asc("id")]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(900))
    assert [r.id for r in got[:300]] == list(range(0, 900, 3))


@pytest.fixture
def steps(spark):
    # score, label: a hand-computed case with a tie of both classes at 0.5.
    data = [(0.9, True), (0.8, True), (0.7, False), (0.5, True), (0.5, False), (0.2, False)]
    return scoring.confusion_steps(spark.createDataFrame(data, "s double, y boolean"), "s", "y")


def test_areas(steps):
    # pairs won: 0.9 and 0.8 beat 3 negatives each, 0.5 beats one and ties one -> 7.5 of 9
    assert scoring.roc_auc(steps).first()[0] == round(7.5 / 9, 4)
    assert scoring.average_precision(steps).first()[0] == round((1 + 1 + 3 / 5) / 3, 4)


def test_curves_and_threshold(steps):
    roc = [(round(r.fpr, 4), round(r.tpr, 4)) for r in scoring.roc_curve(steps).orderBy("fpr", "tpr").collect()]
    # 0.9 is kept as the first point and 0.8 ends the first straight run.
    assert roc == [(0.0, 0.0), (0.0, 0.3333), (0.0, 0.6667), (0.3333, 0.6667), (0.6667, 1.0), (1.0, 1.0)]
    pr = scoring.pr_curve(steps)
    assert pr.count() == 6
    best = scoring.best_threshold(pr).first()
    assert (best.threshold, best.precision_score, best.recall_score, best.f1_score) == (0.8, 1.0, 0.6667, 0.8)


def test_downsample_positions(spark):
    df = spark.range(1000)
    got = [r.position for r in scoring.downsample(df, [F.asc("id")], 200).orderBy("position").collect()]
    assert got == sorted({i * 999 // 199 for i in range(200)})
    assert scoring.downsample(spark.range(50), [F.asc("id")], 200).count() == 50


def test_normalize_and_constant_scores(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", 3.0)], "customer_id string, x double")
    assert rows(scoring.normalize(df, "x").select("customer_id", "anomaly_score")) == [("a", 0.0), ("b", 1.0), ("c", 0.5)]
    flat = df.withColumn("x", F.lit(7.0))
    assert {r.anomaly_score for r in scoring.normalize(flat, "x").collect()} == {0.0}


def test_anomaly_threshold_is_the_interpolated_quantile(spark):
    values = [float(v * v) for v in range(37)]
    df = spark.createDataFrame([(f"c{i:02d}", v) for i, v in enumerate(values)], "customer_id string, x double")
    got = {r.customer_id for r in scoring.flag_anomalies(df, "x", 0.05).filter("is_anomaly").collect()}
    cut = np.quantile(values, 0.95)
    assert got == {f"c{i:02d}" for i, v in enumerate(values) if v > cut}


def test_folds_are_balanced_per_class(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") < 23).alias("y"))
    sizes = rows(scoring.stratified_folds(df, "y", 5).groupBy("y", "fold").count())
    by_class = {y: [n for c, _, n in sizes if c == y] for y in (True, False)}
    assert all(max(n) - min(n) <= 1 and len(n) == 5 for n in by_class.values())
    split = dict(((y, t), n) for y, t, n in rows(scoring.stratified_split(df, "y").groupBy("y", "is_test").count()))
    assert split[(True, True)] == 7 and split[(False, True)] == 24


def test_matrix_takes_logs_and_fills_gaps(spark):
    row = {c: None for c in features.FEATURE_COLUMNS} | {"volume_30d": 99.0, "avg_amount_30d": -5.0, "is_pep": 1}
    ddl = ", ".join(f"{c} double" for c in features.FEATURE_COLUMNS)
    df = spark.createDataFrame([tuple(None if row[c] is None else float(row[c]) for c in features.FEATURE_COLUMNS)], ddl)
    got = features.feature_matrix(df).first()
    assert (got.volume_30d, got.avg_amount_30d, got.is_pep, got.fast_txns) == (math.log1p(99.0), 0.0, 1.0, 0.0)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    inputs = {c: rng.normal(100, 5, 300) for c in features.FEATURE_COLUMNS}
    data = [(f"c{i:03d}", *[float(inputs[c][i]) * (30 if i < 6 else 1) for c in inputs]) for i in range(300)]
    ddl = "customer_id string, " + ", ".join(f"{c} double" for c in inputs)
    return spark.createDataFrame(data, ddl)


def test_isolation_forest_finds_planted_outliers_and_repeats(people):
    forest = iforest.IsolationForest(trees=50)
    scored = forest.fit(people).score(people)
    top = scored.orderBy(F.desc("raw_score")).limit(6).collect()
    assert {r.customer_id for r in top} == {f"c{i:03d}" for i in range(6)}
    again = iforest.IsolationForest(trees=50).fit(people.repartition(3)).score(people)
    assert rows(scored.select("customer_id", "raw_score")) == rows(again.select("customer_id", "raw_score"))
    sizes = forest.nodes[forest.nodes["node"] == 0]["size"]
    assert len(sizes) == 50 and set(sizes) == {256}


def test_triage_learns_and_skips(spark, people):
    labelled = people.withColumn("rule_flagged", F.col("volume_30d") > 101)
    rows_ = triage.training_rows(labelled)
    checked = triage.check_balance(rows_)
    assert checked.trained and checked.folds == 5
    scored = triage.oof(rows_, 2, iterations=3)
    assert scored.count() == 300
    steps = scoring.confusion_steps(scored.withColumn("hit", F.col("label") == 1), "triage_score", "hit")
    assert scoring.roc_auc(steps).first()[0] > 0.9
    one_class = triage.training_rows(people.withColumn("rule_flagged", F.lit(True)))
    skipped = triage.triage_fit(one_class)
    assert not skipped.trained and "positives=300, negatives=0" in skipped.notes
    few = triage.check_balance(rows_.limit(39))
    assert not few.trained and "insufficient data" in few.notes
    record = triage.run_record(
        people.withColumns({"is_anomaly": F.lit(False), "rule_flagged": F.lit(True)}), None, skipped, "v", "2024-01-01"
    ).first()
    assert record.n_samples == 300 and record.roc_auc is None and not record.supervised_trained
