"""What one task holds or joins must not follow the number of files, alerts or payments of the input."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows
from tidewarden.operators import analytics, lookup
from tidewarden.plans import registry
from tidewarden.plans.workspace import Workspace
from tidewarden.streaming.tables import write_batch

NAMES = [(f"CUST-{i:07d}", f"Customer#{i * 37:09d}") for i in range(400)] + [("CUST-0000007", None), ("", ""), ("X", "ab")]


def _parts_by_hand(customers):
    found = {}
    for customer_id, name in customers:
        for body in {customer_id.lower(), (name or "").lower()}:
            for part in {body[i:j] for i in range(len(body)) for j in range(i + 1, min(i + lookup.GRAM, len(body)) + 1)}:
                n, least = found.get(part, (0, customer_id))
                found[part] = n + 1, min(least, customer_id)
    return found


def test_a_single_file_of_customers_is_indexed_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lookup, "TASK_CHARS", 500, raising=False)
    customers = spark.createDataFrame(NAMES, "customer_id string, name string").coalesce(1)
    assert lookup._fields(customers).rdd.getNumPartitions() > 10
    found = {r["part"]: (r["customers"], r["customer_id"]) for r in lookup.build_parts(customers).collect()}
    want = _parts_by_hand(NAMES)
    assert {p: c for p, (_, c) in found.items()} == {p: c for p, (_, c) in want.items()}
    assert all(n == want[p][0] if len(p) == lookup.GRAM else n >= want[p][0] for p, (n, _) in found.items())


@pytest.mark.parametrize("few", [0, 2])
def test_many_texts_with_common_grams_do_not_multiply_with_customers(spark, monkeypatch, few):
    """Texts whose grams several customers have: looked up by their length, not under each of these customers."""
    joined = []
    monkeypatch.setattr(lookup, "PAIRS", 0, raising=False)
    monkeypatch.setattr(lookup, "FEW", few, raising=False)
    monkeypatch.setattr(lookup, "_least", lambda found, least=lookup._least: joined.append(found.count()) or least(found))
    customers = [(f"CUST-{i:07d}", f"1234567{i:03d}") for i in range(100, 160)]
    texts = [f"234567{i}" for i in range(100, 200)] + ["cust-0000111", "9999999"]
    df = spark.createDataFrame(customers, "customer_id string, name string")
    parts = lookup.build_parts(df).cache()
    flags = spark.createDataFrame([], "txn_id string, rule_name string, customer_id string, flagged_at timestamp")
    found = lookup.resolve_targets(
        spark.createDataFrame([(t,) for t in texts], "q string"), df, flags, lookup.Index(parts, lookup.build_postings(df, parts))
    )
    want = []
    for q in texts:
        hits = [c for c, name in customers if q in c.lower() or q in name]
        want += [(q, min(hits))] if hits else []
    assert rows(found.select("q", "customer_id")) == sorted(want)
    assert sum(joined) <= max(few, 0) * len(texts)


def test_targets_over_single_files_are_resolved_by_many_tasks(spark, tmp_path, monkeypatch):
    """The query itself cuts the customers of one file in many tasks, once for each stored table, and finds what a scan finds."""
    spark.range(200).select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", F.col("id") * 37).alias("c_name"),
        F.lit(1).alias("c_nationkey"), F.lit(10.0).alias("c_acctbal"), F.lit("FURNITURE").alias("c_mktsegment"),
    ).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(0, 1000000, 500).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") / 100).cast("int"))).alias("ts"),
        (F.col("id") / 500 % 200).cast("long").alias("user_id"), F.when(F.col("id") % 2500 == 0, "signup").otherwise("click").alias("event_type"),
        F.lit(90.0).alias("value"), F.lit('{"k": 7}').alias("props"),
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    cut, asked = [], []
    fields, resolve = lookup._fields, lookup.resolve_targets
    monkeypatch.setattr(lookup, "TASK_CHARS", 500, raising=False)
    monkeypatch.setattr(lookup, "_fields", lambda customers: cut.append(fields(customers)) or cut[-1])
    monkeypatch.setattr(lookup, "resolve_targets", lambda *args: asked.extend(args) or resolve(*args))
    found = rows(registry.QUERIES["resolve_targets"](Workspace(spark, str(tmp_path))))
    assert found == rows(analytics.resolve_targets(*asked[:3]))
    assert {r[1] for r in found} == {"customer", "alert"}
    assert len(cut) >= 2 and all(df.rdd.getNumPartitions() > 10 for df in cut)


def _writers(path):
    """Files of a written batch as (day, number of the task)."""
    return [(f.parent.name, f.name.split("-")[1]) for f in path.rglob("part-*.parquet")]


def test_a_batch_by_day_is_not_sorted_by_the_task_that_read_it(spark, tmp_path):
    """One input task is dealt to several writers; many input tasks do not all write files of every day."""
    start = F.lit("2024-01-01 12:00:00").cast("timestamp")
    df = spark.range(600).select("id", F.when(F.col("id") % 50 > 0, start + F.make_dt_interval((F.col("id") % 6).cast("int"))).alias("ts"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_batch(df.coalesce(1), str(tmp_path / "one"), 3, day_of="ts")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len({task for _, task in _writers(tmp_path / "one")}) > 1
    write_batch(df.repartition(8), str(tmp_path / "many"), 3, day_of="ts")
    assert len(_writers(tmp_path / "many")) <= 2 * 7
    for name in ("one", "many"):
        assert rows(spark.read.parquet(str(tmp_path / name)).select("id")) == [(i,) for i in range(600)]


def test_payments_of_one_file_are_normalised_by_many_tasks_in_time_order(spark, tmp_path):
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.pmod(F.col("id") * 7919, F.lit(40000)).cast("int"))).alias("ts"),
        (F.col("id") % 50).alias("user_id"), F.when(F.col("id") % 5 == 0, "signup").otherwise("click").alias("event_type"),
        F.col("id").cast("double").alias("value"), F.lit('{"k": 7}').alias("props"),
    )
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = Workspace(spark, str(tmp_path))
        spans = w.txns.groupBy(F.input_file_name()).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(spans) > 1 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
    assert rows(w.txns) == rows(w.normalized)


def test_one_alert_is_archived_without_the_payments_of_the_others(spark):
    w = Workspace(spark, DATA)
    plan = registry.QUERIES["archive_for"](w)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # The stored alerts are known to be few, so the payments are not shuffled to meet them.
    assert "SortMergeJoin" not in text and text.count("transactions-") == 1
    whole = w.archive.select("txn_id", "rule_name", "alert_txn_id", "amount_eur", "ts")
    newest = w.budgeted.orderBy(F.desc("flagged_at"), "txn_id", "rule_name").limit(1).select(F.col("txn_id").alias("alert_txn_id"), "rule_name")
    assert rows(plan) == rows(whole.join(newest, ["alert_txn_id", "rule_name"], "left_semi").select(*plan.columns)) != []
