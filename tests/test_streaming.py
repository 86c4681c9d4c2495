"""A stream of several files must end where the batch operators end."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from tidewarden.plans.workspace import Workspace
from tidewarden.operators import windows
from tidewarden.sources import sinks, tables
from tidewarden.streaming import queries, source
from tidewarden.streaming import tables as batch_tables
from tidewarden.streaming.pipeline import PaymentPipeline


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events in four files in time order."""
    folder = str(tmp_path_factory.mktemp("feed"))
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for part in range(4):
        events.filter((F.col("event_id") * 4 / 1000).cast("int") == part).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture(scope="module")
def w(spark):
    return Workspace(spark, DATA)


def stream(spark, feed):
    return source.payment_stream(spark, feed, files_per_trigger=1)


def test_window_metrics_stream_equals_batch(spark, feed, w, tmp_path):
    got = queries.run_window_metrics(stream(spark, feed), str(tmp_path), w.as_of, "60 days")
    assert rows(got) == rows(windows.window_metrics(w.txns, w.as_of))


def test_duplicate_delivery_is_dropped(spark, feed, tmp_path):
    twice = stream(spark, feed).unionByName(stream(spark, feed))
    path = queries.run_to(queries.stream_dedupe(twice, "60 days"), str(tmp_path))
    assert spark.read.parquet(path).count() == 1000


def test_alerts_once_per_customer_rule_and_window_over_batches(spark, w, tmp_path):
    folder = str(tmp_path / "alerts")
    for _ in range(3):
        w.flags.coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(w.flags.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = queries.run_to(queries.stream_alert_keys(feed), str(tmp_path))
    got = rows(spark.read.parquet(path).select("customer_id", "rule_name", "window_start"))
    window = queries.alert_window(F.col("window_type"), F.col("ts"))
    keyed = w.flags.filter("rule_name <> 'dormant_reactivation'").select("customer_id", "rule_name", window)
    assert got == rows(keyed.distinct())
    assert len({r[1] for r in got}) > 1


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    for event, day in enumerate(("2024-01-20 10:00:00", "2024-01-21 10:00:00", "2024-01-02 10:00:00", "2024-01-02 10:00:00")):
        spark.range(1).select(
            F.lit(event).cast("long").alias("event_id"), F.lit(day).cast("timestamp_ntz").alias("ts"),
            F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
            F.lit('{"k": 1}').alias("props"),
        ).coalesce(1).write.mode("append").parquet(folder)
    feed = source.payment_stream(spark, folder, files_per_trigger=1)
    queries.run_window_metrics(feed, base, F.lit("2024-02-01").cast("timestamp"), "1 day").collect()
    late = rows(queries.late_facts(spark, base).select(F.col("event_ts").cast("string"), "batch_id"))
    whole = windows.transfer_facts(source.binding.payments(spark.read.parquet(folder)))
    assert sum(r["n"] for r in queries.daily_sums(spark, base).collect()) == whole.count()
    assert late and all(r[0] == "2024-01-02 10:00:00" and r[1] >= 2 for r in late)
    # A batch that runs again finds the same facts.
    before = rows(queries.daily_sums(spark, base))
    queries.keep_facts(source.binding.payments(spark.read.parquet(folder)).filter("ts < '2024-01-03'"), base, 3, "1 day")
    assert rows(queries.daily_sums(spark, base)) == before


def test_pipeline_over_several_batches(spark, feed, w, tmp_path):
    pipeline = PaymentPipeline(spark, str(tmp_path), w.customers, global_cap=None, rule_cap=None)
    pipeline.run(stream(spark, feed)).awaitTermination()
    assert pipeline.table("transactions").count() == 1000
    whole = windows.window_metrics(w.txns, w.as_of).drop("computed_at")
    assert rows(pipeline.metrics().drop("computed_at").select(*whole.columns)) == rows(whole)
    flags = pipeline.table("flags")
    keys = rows(flags.select("txn_id", "rule_name"))
    assert len(keys) == len(set(keys))
    # Single-payment rules with one alert per customer and day find the same customers and days.
    one = ["high_value", "geographic", "dormant_reactivation"]
    ours = flags.filter(F.col("rule_name").isin(one)).select("customer_id", "rule_name", F.to_date("ts")).distinct()
    batch = w.evaluated(only=one).select("customer_id", "rule_name", F.to_date("ts")).distinct()
    assert rows(ours) == rows(batch)
    assert pipeline.table("archive").select("alert_txn_id", "rule_name", "txn_id").distinct().count() == pipeline.table("archive").count()


def test_pipeline_can_take_metrics_from_a_stream(spark, feed, w, tmp_path):
    measured = queries.run_window_metrics(stream(spark, feed), str(tmp_path / "metrics"), w.as_of, "60 days")
    pipeline = PaymentPipeline(
        spark, str(tmp_path / "out"), w.customers, global_cap=None, rule_cap=None, metrics_source=lambda: measured
    )
    pipeline.process(w.wire, 0)
    ours = pipeline.table("flags").select("txn_id", "rule_name")
    assert rows(ours) == rows(w.evaluated().select("txn_id", "rule_name"))


def test_a_repeated_batch_changes_nothing_and_an_empty_one_is_skipped(spark, w, tmp_path):
    pipeline = PaymentPipeline(spark, str(tmp_path), w.customers)
    batch = w.wire.filter(F.col("ts") < "2024-01-10")
    pipeline.process(batch, 0)
    later = w.wire.filter((F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-12"))
    pipeline.process(later, 1)
    before = {t: rows(pipeline.table(t).drop("archived_at")) for t in ("transactions", "flags")}
    pipeline.process(later, 1)
    assert {t: rows(pipeline.table(t).drop("archived_at")) for t in before} == before
    assert pipeline.table("flags").count() <= 100
    assert pipeline.table("enriched").count() == pipeline.table("transactions").count()
    pipeline.process(w.wire.limit(0), 2)
    assert pipeline.table("flags").filter("batch_id = 2").count() == 0


def test_a_retry_with_fewer_rows_leaves_no_stale_ones(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, d string")
    for day_of, name in ((None, "plain"), ("d", "days")):
        path = str(tmp_path / name)
        batch_tables.write_batch(df, path, 0, day_of)
        batch_tables.write_batch(df, path, 1, day_of)
        batch_tables.write_batch(df.filter("k = 2"), path, 1, day_of)
        assert rows(spark.read.parquet(path).select("batch_id", "k")) == [(0, 1), (0, 2), (1, 2)]
        batch_tables.write_batch(df.limit(0), path, 1, day_of)
        assert rows(spark.read.parquet(path).select("batch_id", "k")) == [(0, 1), (0, 2)]


def test_compaction_keeps_the_keyed_view(spark, tmp_path):
    path, target = str(tmp_path / "log"), str(tmp_path / "compact")
    for n, v in enumerate(["a", "b"]):
        batch_tables.write_batch(spark.createDataFrame([("k", v), (v, v)], "k string, v string"), path, n)
    view = rows(batch_tables.latest_rows(spark, path, ["k"]))
    batch_tables.compact(spark, path, ["k"], target, 1)
    assert rows(batch_tables.latest_rows(spark, target, ["k"])) == view == [("a", "a"), ("b", "b"), ("k", "b")]


def test_json_source_keeps_wire_timestamps(spark):
    raw = spark.createDataFrame(
        [('{"txn_id": "1", "amount": 5.5, "ts": "2024-01-01T10:00:00.123456+00:00", "extra": 1}',), ("not json",), ('{"amount": 1}',), (None,)],
        "value string",
    )
    good, bad = tables.split_bad_records(raw)
    assert good.count() == 1 and bad.count() == 3
    got = tables.parse_txn_json(raw).select(F.to_timestamp("ts").cast("string"), "merchant").first()
    assert tuple(got) == ("2024-01-01 10:00:00.123456", None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "k string, d string").select("k", F.to_timestamp("d").alias("ts"))
    path = str(tmp_path / "t")
    sinks.append(df, path)
    sinks.append(df.filter("k = 'a'"), path)
    assert spark.read.parquet(path).count() == 3
    sinks.overwrite_days(df.filter("k = 'a'"), path)
    assert spark.read.parquet(path).count() == 2
    sinks.to_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["k", "ts"]
    run = sinks.export_gold(df, str(tmp_path / "gold"), "mart", "20240101T000000Z")
    sinks.export_gold(df.limit(1), str(tmp_path / "gold"), "mart", "20240102T000000Z")
    assert os.path.isdir(run) and spark.read.parquet(str(tmp_path / "gold" / "mart_current")).count() == 1
    assert spark.read.parquet(str(tmp_path / "gold" / "mart")).count() == 3
    sinks.replace_snapshot(df, str(tmp_path / "snap"))
    sinks.replace_snapshot(df.limit(1), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1
    sinks.append_run(df.limit(1), str(tmp_path / "runs"))
    sinks.append_run(df.limit(1), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
