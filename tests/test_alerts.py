from decimal import Decimal

from pyspark.sql import functions as F

from conftest import at, rows, txn
from tidewarden.operators import alerts
from tidewarden.sources import sinks

FLAGS = (
    "txn_id string, customer_id string, rule_name string, amount decimal(18,2), amount_eur decimal(18,2), "
    "ts timestamp, flagged_at timestamp, alert_priority_score decimal(5,2)"
)


def flag(spark, entries):
    full = [
        (str(i), c, r, Decimal(a), Decimal(a), at(t), at(t), None if p is None else Decimal(p))
        for i, c, r, a, t, p in entries
    ]
    return spark.createDataFrame(full, FLAGS)


def test_priority_formula(spark, make_customers):
    flags = flag(
        spark,
        [
            (1, "A", "geographic", "5000.00", "2024-01-01 00:00", None),
            (2, "A", "geographic", "123.45", "2024-01-01 00:00", None),
            (3, "B", "unknown_rule", "0.00", "2024-01-01 00:00", None),
            (4, "C", "mule_inbound", "99999.00", "2024-01-01 00:00", None),
        ],
    ).drop("alert_priority_score")
    people = make_customers([("A", "a", Decimal(50), "active"), ("C", "c", Decimal(100), "active")])
    got = {r.txn_id: float(r.alert_priority_score) for r in alerts.alert_priority(flags, people).collect()}
    assert got == {"1": 80.0, "2": 74.15, "3": 30.0, "4": 95.2}
    old = {r.txn_id: float(r.alert_priority_score) for r in alerts.backfill_priority(flags, people).collect()}
    assert old["4"] == 76.0 and old["1"] == 80.0


def counts(spark, **used):
    return spark.createDataFrame(list(used.items()), "rule_name string, alert_count long")


def test_budget_takes_caps_off_even_when_a_rule_has_fewer_alerts(spark):
    new = flag(
        spark,
        [(i, "A", "r1", "1", "2024-01-01 00:00", str(i)) for i in range(3)]
        + [(i, "A", "r2", "1", "2024-01-01 00:00", str(i)) for i in range(10, 30)]
        + [(i, "A", "r3", "1", "2024-01-01 00:00", str(i)) for i in range(40, 60)],
    )
    # r1 has headroom 5 (3 alerts), r2 4, r3 2; 9 left in total: r1 reserves 5, r2 takes 4, r3 gets none.
    got = alerts.apply_budget(new, counts(spark, r2=1, r3=3, gone=7), global_cap=20, rule_cap=5)
    assert rows(got.groupBy("rule_name").count()) == [("r1", 3), ("r2", 4)]
    assert rows(got.filter("rule_name = 'r2'").select("txn_id")) == [("26",), ("27",), ("28",), ("29",)]


def test_budget_exhausted_and_saturated(spark):
    new = flag(spark, [(1, "A", "r1", "1", "2024-01-01 00:00", "1")])
    assert alerts.apply_budget(new, counts(spark, other=100)).count() == 0
    assert alerts.apply_budget(new, counts(spark, r1=12)).count() == 0
    assert alerts.apply_budget(new, counts(spark, r1=11)).count() == 1
    assert alerts.apply_budget(new, counts(spark, x=0)).count() == 1


def test_budget_never_exceeds_its_caps(spark):
    new = flag(spark, [(i, "A", f"r{i % 15}", "1", "2024-01-01 00:00", str(i % 90)) for i in range(600)])
    got = alerts.apply_budget(new, counts(spark, r1=3))
    per_rule = dict(rows(got.groupBy("rule_name").count()))
    assert max(per_rule.values()) <= 12 and per_rule.get("r1", 0) <= 9
    assert sum(per_rule.values()) <= 97


def test_archive_has_each_payment_once_per_alert(spark, make_txns):
    txns = make_txns(
        [
            txn(1, "A", 1, "2024-01-01 10:00", receiver="B"),
            txn(2, "B", 1, "2024-01-02 10:00", receiver="A"),
            txn(3, "A", 1, "2024-01-03 10:00", receiver="A"),
            txn(4, "C", 1, "2024-01-04 10:00", receiver="D"),
        ]
    )
    raised = flag(spark, [(1, "A", "r1", "1", "2024-01-01 00:00", None), (3, "A", "r1", "1", "2024-01-01 00:00", None), (9, None, "r1", "1", "2024-01-01 00:00", None)])
    got = alerts.archive(raised, txns.unionByName(txns), "2024-02-01")
    assert rows(got.select("alert_txn_id", "txn_id")) == [(a, t) for a in ("1", "3") for t in ("1", "2", "3")]
    assert rows(alerts.archive_counts(got).select("alert_txn_id", "archived_txns")) == [("1", 3), ("3", 3)]


def test_queue_order_paging_and_disposition(spark, make_customers):
    raised = flag(
        spark,
        [
            (1, "A", "r", "1", "2024-01-01 00:00", None), (2, "A", "r", "1", "2024-01-01 00:00", "50"),
            (3, "A", "r", "1", "2024-01-02 00:00", "50"), (4, "A", "r", "1", "2024-01-01 00:00", "90"),
        ],
    )
    people = make_customers([("A", "a", Decimal(50), "active")])
    done = spark.createDataFrame([("4", "r", "sar_filed", None, at("2024-01-03 00:00"))], "txn_id string, rule_name string, disposition string, analyst_notes string, created_at timestamp")
    assert rows(alerts.open_alerts(raised, done, people, 2, 0).select("alert_id")) == [("2",), ("3",)]
    assert rows(alerts.open_alerts(raised, done, people, 2, 2).select("alert_id")) == [("1",)]
    again = done.withColumn("disposition", F.lit("false_positive"))
    merged = alerts.record_disposition(done, again)
    assert rows(merged.select("disposition")) == [("false_positive",)]
    assert alerts.alert_counts(raised, merged).first().asDict() == {"open_alerts": 3, "dispositioned": 1}


def test_upsert_and_insert_new(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    assert rows(sinks.upsert(old, new, ["k"], [F.desc("v")])) == [("a", 1), ("b", 3), ("c", 1)]
    assert rows(sinks.insert_new(old, new, ["k"])) == [("c", 1)]


def test_alert_lookup(spark, make_txns):
    txns = make_txns([txn(1, "A", 1, "2024-01-01 10:00", receiver="B")])
    raised = flag(
        spark,
        [(1, "A", "r2", "1", "2024-01-01 00:00", None), (1, "A", "r1", "1", "2024-01-01 00:00", None), (2, "A", "r1", "1", "2024-01-01 00:00", None)],
    )
    found = alerts.alert_by_txn(raised, txns, "1").collect()
    assert [(r.rule_name, r.receiver_id) for r in found] == [("r1", "B")]
    assert alerts.alert_by_txn(raised, txns, "1", "r2").first().rule_name == "r2"
    done = spark.createDataFrame(
        [("1", "r1", "sar_filed", "n", at("2024-01-03 00:00"))],
        "txn_id string, rule_name string, disposition string, analyst_notes string, created_at timestamp",
    )
    assert alerts.alert_disposition(done, "1", "r1").first().disposition == "sar_filed"
    assert alerts.alert_disposition(done, "1", "r2").count() == 0
    archived = alerts.archive(raised, txns, "2024-02-01")
    assert alerts.archive_for(archived, "1", "r2", "A").count() == 1
