"""Hot keys, large selections, laid-out payments, sketches and folded logs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows, txn
from tidewarden.operators import analytics, enrich, heavy, quality, selection, sketches
from tidewarden.plans import registry
from tidewarden.plans.workspace import Workspace
from tidewarden.sources import layout
from tidewarden.streaming import tables as batch_tables


@pytest.fixture(scope="module")
def w(spark):
    return Workspace(spark, DATA)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def leaves(df):
    """The scans of the plan as it ran."""
    df.collect()
    run = df._jdf.queryExecution().executedPlan()
    if run.nodeName() == "AdaptiveSparkPlan":
        run = run.finalPhysicalPlan()
    found = run.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def half_for_one(spark, n=4000):
    """Half of all payments belong to one party, the others to many; some have none."""
    party = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("p"), F.col("id") % 300))
    return spark.range(n).select(F.col("id").alias("txn_id"), party.alias("party_id"))


def test_heavy_keys_are_found_without_shuffling_rows(spark):
    assert heavy.heavy_keys(half_for_one(spark), "party_id") == ["hot"]
    assert heavy.heavy_keys(half_for_one(spark).limit(0), "party_id") == []
    assert heavy.heavy_keys(half_for_one(spark).withColumn("party_id", F.lit(None).cast("string")), "party_id") == []
    with pytest.raises(ValueError):
        heavy.heavy_keys(half_for_one(spark), "party_id", share=0.001, most=10)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_salted_join_is_the_join(spark, how):
    large = half_for_one(spark)
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("p1", 3), (None, 4), ("nobody", 5)], "customer_id string, v int")
    plainly = large.join(other, large["party_id"] == other["customer_id"], how)
    for keys in (["hot"], ["hot", "p1", "nobody"], []):
        got = heavy.salted_join(large, other, "party_id", "customer_id", keys, how, salts=8)
        assert got.columns == plainly.columns and sorted(map(str, got.collect())) == sorted(map(str, plainly.collect()))
    with pytest.raises(ValueError):
        heavy.salted_join(large, other, "party_id", "customer_id", ["hot"], "full")


def test_no_task_of_a_salted_join_holds_the_hot_party(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "32"), strict=True):
        spark.conf.set(k, v)
    try:
        other = spark.createDataFrame([("hot", 1), ("p1", 3)], "customer_id string, v int")

        def largest(keys):
            joined = heavy.salted_join(half_for_one(spark), other, "party_id", "customer_id", keys, salts=32)
            return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        assert largest([]) >= 2000 and largest(["hot"]) < 700
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_heavy_parties_leave_the_party_join_as_it_is(w):
    alerted = w.flags.select("customer_id").distinct()
    sides = w.txns.select("txn_id", "sender_customer_no", "receiver_customer_no")
    keys = [r[0] for r in enrich.by_party(sides).groupBy("party_id").count().orderBy(F.desc("count")).limit(5).collect()]
    columns = ["customer_id", "party_txn_id"]
    assert rows(enrich.party_join(alerted, sides, keys).select(columns)) == rows(enrich.party_join(alerted, sides).select(columns))


ORDERS = [
    [("a", True), ("b", False), ("id", True)],
    [("t", False), ("a", False), ("id", False)],
    [("t", True), ("b", True), ("id", False)],
    [("id", True)],
]


@pytest.mark.parametrize("order", ORDERS)
def test_selection_takes_what_a_sort_takes(spark, order):
    n = F.col("id")
    df = spark.range(500).select(
        "id", F.when(n % 11 != 0, n % 5).alias("a"), F.when(n % 13 != 0, F.concat(F.lit("x"), n % 3)).alias("b"),
        F.when(n % 17 != 0, F.timestamp_seconds(n % 4)).alias("t"),
    )
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    whole = [r["id"] for r in df.orderBy(*by).collect()]
    for k in (1, 3, 100, 101, 499, 500, 900):
        got = selection.first_rows(df, k, order, page_rows=0)
        assert sorted(r["id"] for r in got.collect()) == sorted(whole[:k]), (k, order)
        assert "TakeOrdered" not in plan(got)
    assert selection.first_rows(df.limit(0), 3, order, page_rows=0).count() == 0
    assert [r["id"] for r in selection.first_rows(df, 5, order).collect()] == whole[:5]


def test_selection_refuses_an_order_with_ties(spark):
    with pytest.raises(ValueError):
        selection.first_rows(spark.range(10).select((F.col("id") % 2).alias("a")), 3, [("a", False)], page_rows=0)


def test_laid_out_payments_are_pruned_by_day_and_party(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "GROUP_ROWS", 2000)
    monkeypatch.setattr(layout, "PAGE_ROWS", 500)
    days = [f"2024-01-{d:02d}" for d in range(1, 11)]
    day = F.element_at(F.array(*map(F.lit, days)), (F.col("id") % 10 + 1).cast("int"))
    key = F.format_string("C%05d", F.pmod(F.xxhash64("id"), F.lit(20000)))
    txns = spark.range(200_000).select(
        F.col("id").cast("string").alias("txn_id"), F.lit(None).cast("string").alias("sender_customer_no"), key.alias("sender_id"),
        F.format_string("C%05d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(20000))).alias("receiver_customer_no"),
        (day.cast("timestamp") + F.make_interval(hours=(F.col("id") % 24).cast("int"))).alias("ts"),
    )
    layout.lay_out(txns, str(tmp_path / "laid"))
    laid = spark.read.parquet(str(tmp_path / "laid"))
    recent = layout.since(laid, "2024-01-10 06:00:00")
    assert "PartitionFilters: [isnotnull(day" in plan(recent)
    assert rows(recent.select("txn_id")) == rows(txns.filter("ts >= '2024-01-10 06:00:00'").select("txn_id"))
    one = layout.sent_by(laid, "C00042")
    assert rows(one.select("txn_id")) == rows(txns.filter("sender_id = 'C00042'").select("txn_id"))
    read = sum(scan.metrics().apply("numOutputRows").value() for scan in leaves(one))
    assert 0 < read < 20_000  # nine of ten rows are skipped
    both = layout.of_customer(laid, "C00042")
    assert rows(both.select("txn_id")) == rows(txns.filter("sender_id = 'C00042' or receiver_customer_no = 'C00042'").select("txn_id"))
    # A party without payments lies inside the range of every file: only the Bloom filters rule it out.
    nobody = layout.of_customer(laid, "C00042x")
    assert sum(scan.metrics().apply("numOutputRows").value() for scan in leaves(nobody)) < 20_000


def test_sketches_roll_up_within_their_error_and_stay_small(spark, make_txns):
    many = spark.range(60_000).select(
        F.lit("A").alias("sender_id"), F.lit("A").alias("sender_customer_no"), (F.col("id") % 20_000).cast("string").alias("receiver_id"),
        (F.col("id") % 20_000).cast("string").alias("receiver_customer_no"), F.col("id").cast("decimal(18,2)").alias("amount_eur"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 7).cast("int")).cast("timestamp").alias("ts"),
    )
    daily = sketches.daily_sketches(many)
    assert daily.count() == 7 and daily.agg(F.max(F.length("receivers"))).first()[0] < 5000
    found = sketches.receivers_between(daily, "2024-01-01", "2024-01-07").first()["receivers"]
    exact = sketches.exact_between(many, "2024-01-01", "2024-01-07").first()["receivers"]
    assert exact == 20_000 and abs(found - exact) < 4 * sketches.ERROR * exact
    few = make_txns([txn(i, "B", i, f"2024-01-0{1 + i % 3} 10:00", receiver=f"r{i % 2}", receiver_customer_no=None) for i in range(9)])
    assert sketches.receivers_between(sketches.daily_sketches(few), "2024-01-01", "2024-01-03").first()["receivers"] == 2


def test_the_grid_has_every_day_of_every_rule(w):
    grid = analytics.alert_grid(w.flags, w.as_of, 10)
    counts = {r[0]: r[1] for r in grid.groupBy("rule_name").count().collect()}
    assert counts and set(counts.values()) == {10}
    assert grid.filter("alerts = 0").count() > 0
    assert grid.agg(F.sum("alerts")).first()[0] == w.flags.filter("flagged_at >= '2024-01-21' and flagged_at < '2024-01-31'").count()
    assert analytics.alert_grid(w.flags.limit(0), w.as_of).count() == 0


def test_values_are_listed_for_violators_only(w):
    text = plan(quality.dq_sender_name(w.txns))
    assert "LeftSemi" in text and text.index("collect_set") < text.index("LeftSemi")
    assert "partial_min" in text and "partial_max" in text


def test_alerted_payments_are_read_for_the_alerts_own_time(w):
    text = plan(registry.QUERIES["segmentation_txn_type"](w))
    assert text.count("LessThanOrEqual(ts") >= 1


def test_a_folded_log_counts_every_row_once(spark, tmp_path):
    total = lambda log: log.groupBy("k").agg(F.sum("v").alias("v")).withColumn("batch_id", F.lit(-1))
    log = batch_tables.UpdateLog(spark, str(tmp_path / "log"), total, every=3)
    batch = lambda n: spark.createDataFrame([("a", 1), (f"k{n}", 10)], "k string, v long")
    with pytest.raises(ValueError):
        log.rows()
    for n in range(8):
        log.write(batch(n), n)
        log.write(batch(n), n)  # runs again
        assert rows(log.rows(n)) == rows(batch(n))
        assert rows(log.rows()) == sorted([("a", n + 1), *((f"k{i}", 10) for i in range(n + 1))])
    assert log.through() == 5 and log._batches() == [6, 7]
    log.write(batch(2), 2)  # folded long ago
    assert dict(rows(log.rows()))["a"] == 8
    # A failure after the version was published and before the folders went.
    batch_tables.write_batch(batch(4), os.path.join(str(tmp_path / "log"), "log"), 4)
    assert dict(rows(log.rows()))["a"] == 8
    log.compact(7)
    assert dict(rows(log.rows()))["a"] == 8 and log._batches() == []


def test_alerts_of_earlier_days_are_not_read_again(spark, w, tmp_path):
    like = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "k string, ts timestamp")
    for n, day in enumerate((dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 1))):
        batch_tables.write_batch(spark.createDataFrame([(str(n), day)], "k string, ts timestamp"), str(tmp_path), n, day_of="ts")
    recent = batch_tables.read_before(spark, str(tmp_path), 5, like, F.lit("2023-12-01").cast("date"))
    assert rows(recent.select("k")) == [("1",)]
    scan = [line for line in plan(recent).splitlines() if "PartitionFilters" in line][0]
    assert "(day#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
