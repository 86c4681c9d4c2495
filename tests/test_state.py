"""Sessions, late rows, alert episodes, versioned and keyed tables over several batches."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import DATA, rows, txn
from tidewarden.operators import sessions
from tidewarden.plans.workspace import Workspace
from tidewarden.sources import sinks
from tidewarden.sources.keyed import KeyedTable
from tidewarden.sources.versions import Conflict, VersionedTable
from tidewarden.streaming import kept, lifecycle, queries
from tidewarden.streaming.tables import write_batch


def pay(make_txns, *payments):
    return make_txns([txn(i, who, eur, when, sender_customer_no=who) for i, who, eur, when in payments])


def found(df):
    return sorted((r["sender_id"], str(r["first_ts"]), str(r["last_ts"]), r["txn_count"], float(r["volume"])) for r in df.collect())


def test_a_late_payment_joins_the_sessions_it_lies_between(spark, make_txns, tmp_path):
    base = str(tmp_path)
    first = pay(make_txns, (1, "A", 10, "2024-01-01 10:00"), (2, "A", 20, "2024-01-01 10:50"), (3, None, 5, "2024-01-01 10:00"))
    kept.keep_sessions(first, base, 0)
    assert [r[3] for r in found(kept.kept_sessions(spark, base))] == [1, 1]
    late = pay(make_txns, (4, "A", 1, "2024-01-01 10:25"), (5, "A", 2, "2024-01-01 11:20:00.000001"))
    kept.keep_sessions(late, base, 1)
    want = [
        ("A", "2024-01-01 10:00:00", "2024-01-01 10:50:00", 3, 31.0),
        ("A", "2024-01-01 11:20:00.000001", "2024-01-01 11:20:00.000001", 1, 2.0),
    ]
    assert found(kept.kept_sessions(spark, base)) == want
    kept.keep_sessions(late, base, 1)  # the batch runs again
    assert found(kept.kept_sessions(spark, base)) == want
    assert found(sessions.sessions(first.union(late))) == want
    closed = sessions.bursts(kept.kept_sessions(spark, base), closed_by=F.lit("2024-01-01 11:20:00").cast("timestamp"))
    assert closed.count() == 0 and sessions.bursts(kept.kept_sessions(spark, base)).count() == 1


def test_partial_sessions_equal_the_built_in_window(spark):
    w = Workspace(spark, DATA)
    for gap in ("20 minutes", "5 hours", "3 days"):
        whole = sessions.sent(w.wire).groupBy("sender_id", F.session_window("ts", gap)).agg(F.min("ts"), F.max("ts"), F.count("*"))
        ours = sessions.sessions(w.wire, gap).select("sender_id", "first_ts", "last_ts", "txn_count")
        assert rows(ours) == rows(whole.drop("session_window"))


def test_a_hot_sender_is_cut_by_the_hour(spark, make_txns):
    df = sessions.partial_sessions(make_txns([txn(i, "A", 1, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00", sender_customer_no="A") for i in range(200)]))
    assert df.count() == 200
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sender_id" in plan and "hour" in plan


def test_closed_bursts_leave_a_stream_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "sender_customer_no string, sender_id string, ts timestamp, amount_eur decimal(18,2)"
    times = [["2024-01-01 10:00", "2024-01-01 10:10"], ["2024-01-01 10:20"], ["2024-01-09 00:00"], ["2024-01-20 00:00"]]
    for batch in times:
        df = spark.createDataFrame([("A", t) for t in batch], "sender_id string, t string")
        df = df.select(F.lit(None).cast("string").alias("sender_customer_no"), "sender_id", F.to_timestamp("t").alias("ts"), F.lit(2).cast("decimal(18,2)").alias("amount_eur"))
        df.coalesce(1).write.mode("append").parquet(folder)
        path = queries.run_to(kept.stream_sessions(spark.readStream.schema(schema).parquet(folder), lateness="1 day"), str(tmp_path / "out"))
    assert found(spark.read.parquet(path)) == [("A", "2024-01-01 10:00:00", "2024-01-01 10:20:00", 3, 6.0)]


def test_late_payments_are_counted_in_their_windows_and_marked(spark, make_txns, tmp_path):
    cfg = {"velocity": {"window_minutes": 5, "max_txns_per_account": 1}}
    batches = [
        pay(make_txns, (1, "A", 1, "2024-01-10 10:00")),
        pay(make_txns, (2, "A", 1, "2024-01-01 10:00"), (3, "A", 1, "2024-01-01 10:01"), (1, "A", 1, "2024-01-10 10:00")),
        pay(make_txns, (4, "A", 1, "2024-01-01 10:02")),
    ]
    for n, batch in enumerate(batches):
        for _ in range(2):  # every batch runs twice
            kept.keep_minutes(batch, str(tmp_path / "v"), n)
            kept.keep_once(batch, str(tmp_path / "p"), n)
    counts = {(str(r["window_start"]), r["txn_count"], r["late_count"]) for r in kept.kept_velocity(spark, str(tmp_path / "v"), cfg).collect()}
    assert ("2024-01-01 09:58:00", 3, 3) in counts and ("2024-01-10 10:00:00", 2, 0) in counts
    payments = spark.read.parquet(str(tmp_path / "p" / "payments"))
    assert rows(payments.select("txn_id", "late")) == [("1", False), ("2", True), ("3", True), ("4", True)]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p" / "counts")).orderBy("batch_id").select("arrived", "kept", "repeats").collect()] == [(1, 1, 0), (3, 2, 1), (1, 1, 0)]


EVENT = "customer_id string, rule_name string, kind string, ts timestamp, disposition string"


def test_alert_episodes_over_batches_with_decision_and_timer(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def deliver(*events):
        df = spark.createDataFrame(events, EVENT.replace("ts timestamp", "t string"))
        df.select("customer_id", "rule_name", "kind", F.to_timestamp("t").alias("ts"), "disposition").coalesce(1).write.mode("append").parquet(folder)
        got = lifecycle.run_episodes(spark.readStream.schema(EVENT).parquet(folder), out, memory_days=5, lateness="1 day")
        return sorted((r["customer_id"], r["change"], str(r["first_ts"]), str(r["last_ts"]), r["alert_count"], r["disposition"]) for r in got.collect())

    one = deliver(
        ("a", "r", "alert", "2024-01-01 11:00:00", None), ("a", "r", "alert", "2024-01-01 10:00:00", None), ("b", "r", "alert", "2024-01-01 09:00:00", None),
        ("d", "r", "decision", "2024-01-01 09:00:00", "none open"), (None, "r", "alert", "2024-01-01 09:00:00", None),
    )
    opened = [("a", "opened", "2024-01-01 10:00:00", "2024-01-01 10:00:00", 1, None), ("b", "opened", "2024-01-01 09:00:00", "2024-01-01 09:00:00", 1, None)]
    assert one == opened
    two = deliver(("a", "r", "alert", "2024-01-02 11:00:00", None), ("a", "r", "decision", "2024-01-01 12:00:00", "cleared"))
    again = [("a", "decided", "2024-01-01 10:00:00", "2024-01-01 11:00:00", 2, "cleared"), ("a", "opened", "2024-01-02 11:00:00", "2024-01-02 11:00:00", 1, None)]
    assert two == sorted(opened + again)
    three = deliver(("c", "r", "alert", "2024-01-20 09:00:00", None))
    gone = [
        ("a", "expired", "2024-01-02 11:00:00", "2024-01-02 11:00:00", 1, None), ("b", "expired", "2024-01-01 09:00:00", "2024-01-01 09:00:00", 1, None),
        ("c", "opened", "2024-01-20 09:00:00", "2024-01-20 09:00:00", 1, None),
    ]
    assert three == sorted(opened + again + gone)
    # The timers removed the state: the key is armed again.
    assert ("b", "opened", "2024-01-21 09:00:00", "2024-01-21 09:00:00", 1, None) in deliver(("b", "r", "alert", "2024-01-21 09:00:00", None))
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def files_below(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_small_update_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ["k"], buckets=16)
    table.upsert(spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v")), [F.desc("v")])
    before = table.current()
    after = table.upsert(spark.createDataFrame([(7, "b"), (7, "c"), (900, "d")], "k long, v string"), [F.desc("v")])
    changed = {p for p in after.parts if after.parts[p] != before.parts.get(p)}
    assert len(changed) <= 2 and len(before.parts) == 16
    read = {f.split("/", 3)[-1] for f in table.read().inputFiles()}
    kept_files = {f for f in files_below(path) if any(f"/{before.parts[p]}/" in f for p in before.parts if p not in changed)}
    assert kept_files and all(any(f.endswith(r.rsplit("/", 1)[-1]) for r in read) for f in kept_files)
    assert table.read().count() == 401 and rows(table.read().filter("k in (7, 900)")) == [(7, "c"), (900, "d")]
    assert rows(table.read(before.number).filter("k = 7")) == [(7, "old")]
    assert rows(table.lookup(spark.createDataFrame([(7,), (5,), (-1,)], "k long"))) == [(5, "old"), (7, "c")]
    lookup = table.lookup(spark.createDataFrame([(7,)], "k long"))
    assert len({os.path.dirname(f) for f in lookup.inputFiles()}) == 1
    table.insert_new(spark.createDataFrame([(7, "no"), (901, "yes")], "k long, v string"))
    table.delete(spark.createDataFrame([(900,), (5,)], "k long"))
    assert table.read().count() == 400 and rows(table.read().filter("k in (5, 7, 900, 901)")) == [(7, "c"), (901, "yes")]
    with pytest.raises(ValueError):
        KeyedTable(spark, path, ["k"], buckets=4).delete(spark.createDataFrame([(1,)], "k long"))


def test_a_repeated_batch_and_an_emptied_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=4)
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert table.upsert(df, [F.desc("v")], batch=0).number == 1
    assert table.upsert(df, [F.desc("v")], batch=0).number == 1
    assert table.upsert(df.limit(0), [F.desc("v")], batch=1).number == 2 and table.read().count() == 1
    table.delete(df)
    assert table.read().count() == 0 and table.read().columns == ["k", "v"]
    assert table.upsert(df, [F.desc("v")], batch=2).number == 4 and table.read().count() == 1


def test_a_stream_keeps_a_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    for n, v in enumerate("abc"):
        write_batch(spark.createDataFrame([("k", v), (v, v)], "k string, v string"), str(tmp_path / "in"), n)
    feed = spark.readStream.schema("k string, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    queries.start(feed, lambda batch, n: table.upsert(batch, [F.desc("v")], n), str(tmp_path / "checkpoint")).awaitTermination()
    assert {r[0] for r in rows(table.read())} == {"a", "b", "c", "k"}
    assert table.current().notes["batch"] >= 1


def test_readers_never_see_half_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path)
    with pytest.raises(ValueError):
        table.read()
    table.publish(spark.range(10))
    reader = table.read()
    table.publish(table.read().filter("id < 3"))  # reads the version before
    assert reader.count() == 10 and table.read().count() == 3 and table.read(1).count() == 10

    # A write that fails, and one that ends between the data and the version, leave the old version.
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        table.publish(broken)
    spark.range(7).write.parquet(table.full(table.new_folder()))
    assert table.read().count() == 3
    # A version file that its writer did not finish does not count, and the next number is free.
    half = os.path.join(path, "_versions", f"{3:012d}.json")
    with open(half, "w") as f:
        f.write('{"parts": {"all"')
    assert table.read().count() == 3 and table.publish(spark.range(4)).number == 4 and table.read().count() == 4

    base = table.current()
    table.publish(spark.range(1))
    with pytest.raises(Conflict):
        table.commit(base, base.parts, base.schema)
    assert len(table.vacuum(keep=1)) >= 4 and table.read().count() == 1
    with pytest.raises(ValueError):
        table.read(1)


def test_gold_and_snapshots_are_published_as_versions(spark, tmp_path):
    base = str(tmp_path)
    for n in range(1, 4):
        sinks.publish_gold(spark.range(n), base, "mart", f"2024010{n}T000000Z")
    current = VersionedTable(spark, os.path.join(base, "mart_current"))
    assert current.read().count() == 3 and current.read(2).count() == 2 and current.current(1) is None
    assert spark.read.parquet(os.path.join(base, "mart")).count() == 6
