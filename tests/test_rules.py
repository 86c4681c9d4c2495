from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows, txn
from tidewarden.operators import rules, windows
from tidewarden.operators.normalize import synthetic_only

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture
def evaluate(make_txns, make_customers):
    def run(payments, customers=(("A", "a", 10, "active"),), **options):
        txns = make_txns(payments)
        people = make_customers([(c, n, Decimal(r), s) for c, n, r, s in customers])
        metrics = windows.window_metrics(txns, AS_OF)
        return rules.evaluate_rules(txns, metrics, people, flagged_at=F.col("ts"), **options)

    return run


def ids(df, *cols):
    return rows(df.select(*(cols or ("txn_id",))))


def test_high_value_is_strict(evaluate):
    payments = [txn(1, "A", "10000.00", "2024-01-10 10:00"), txn(2, "B", "10000.01", "2024-01-10 11:00")]
    assert ids(evaluate(payments, only=["high_value"])) == [("2",)]


def test_newest_payment_wins_and_ties_go_to_the_lower_id(evaluate):
    payments = [
        txn(1, "A", 20000, "2024-01-10 10:00"),
        txn(3, "A", 20001, "2024-01-10 12:00"),
        txn(2, "A", 20002, "2024-01-10 12:00"),
        txn(4, "A", 20003, "2024-01-11 09:00"),
    ]
    assert ids(evaluate(payments, only=["high_value"])) == [("2",), ("4",)]


def test_weekly_volume_is_strict(evaluate):
    at_limit = [txn(i, "A", 5000, f"2024-01-0{i} 10:00") for i in (2, 3)]
    assert ids(evaluate(at_limit, only=["weekly_volume"])) == []
    above = at_limit + [txn(9, "A", "0.01", "2024-01-04 10:00")]
    found = evaluate(above, only=["weekly_volume"]).collect()
    assert [(r.txn_id, r.rule_detail) for r in found] == [("9", "weekly volume 10000.01 EUR exceeds 10000.0")]


def test_daily_velocity_counts_all_amounts_but_flags_small_ones(evaluate):
    payments = [txn(i, "A", 1000 if i == 1 else 1001, f"2024-01-10 0{i}:00") for i in range(1, 7)]
    assert ids(evaluate(payments, only=["daily_velocity"])) == [("1",)]
    assert ids(evaluate(payments[:5], only=["daily_velocity"])) == []


def test_smurfing_needs_twelve_in_a_week(evaluate):
    payments = [txn(i, "A", 500 if i == 5 else 501, f"2024-01-10 {i:02d}:00") for i in range(12)]
    assert ids(evaluate(payments, only=["smurfing"])) == [("5",)]
    assert ids(evaluate(payments[1:], only=["smurfing"])) == []


def test_monthly_peer_needs_more_than_twenty(evaluate):
    payments = [txn(i, "A", 1, f"2024-01-{i + 1:02d} 10:00") for i in range(21)]
    assert ids(evaluate(payments, only=["monthly_peer_anomaly"])) == [("20",)]
    assert ids(evaluate(payments[:20], only=["monthly_peer_anomaly"])) == []


def test_geographic_tests_only_the_first_known_country(evaluate):
    payments = [
        txn(1, "A", 1, "2024-01-10 10:00", sender_country="DE", receiver_country="KP"),
        txn(2, "B", 1, "2024-01-10 10:00", sender_country=None, receiver_country="RU"),
        txn(3, "C", 1, "2024-01-10 10:00", sender_country=None, receiver_country=None, country_code="IR"),
    ]
    assert ids(evaluate(payments, only=["geographic"])) == [("2",), ("3",)]


def test_dormant_keeps_every_payment_from_the_limit_on(evaluate):
    payments = [txn(1, "A", 3000, "2024-01-10 10:00"), txn(2, "A", 4000, "2024-01-10 11:00"), txn(3, "A", "2999.99", "2024-01-10 12:00")]
    found = evaluate(payments, customers=[("A", "a", 10, "dormant")], only=["dormant_reactivation"])
    assert ids(found) == [("1",), ("2",)]


def _inbound(i, receiver, identity, when="2024-01-10 10:00", **more):
    return txn(
        i, None, 10, when, receiver=receiver, is_customer_receiver=True, is_customer_sender=False,
        sender_identity_no=identity, **more,
    )


def test_mule_needs_five_distinct_senders_on_a_day(evaluate):
    four = [_inbound(i, "M", str(i)) for i in range(4)] + [_inbound(9, "M", "0")]
    assert ids(evaluate(four, only=["mule_inbound"])) == []
    five = four + [_inbound(5, "M", "5", "2024-01-10 11:00")]
    assert ids(evaluate(five, only=["mule_inbound"]), ) == [("5",)]
    assert ids(evaluate(five, only=["mule_inbound"], mule_min_total_eur=60.01)) == []
    split = four + [_inbound(5, "M", "5", "2024-01-11 11:00")]
    assert ids(evaluate(split, only=["mule_inbound"])) == []


def test_alert_is_raised_on_the_receiving_customer(evaluate):
    payments = [txn(1, "A", 20000, "2024-01-10 10:00", receiver="B", is_customer_receiver=True)]
    found = evaluate(payments, only=["high_value"])
    assert ids(found, "customer_id", "account_id") == [("B", "A")]


def test_scope_limits_rules_to_scenario_payments(evaluate):
    payments = [txn(1, "A", 20000, "2024-01-10 10:00", is_synthetic_fraud=False), txn(2, "B", 20000, "2024-01-10 10:00")]
    assert ids(evaluate(payments, only=["high_value"], predicate=synthetic_only())) == [("2",)]


def test_all_rules_are_unique_by_payment_and_rule(evaluate):
    payments = [txn(i, "A", 3000 + i, f"2024-01-10 {i:02d}:00", sender_country="RU") for i in range(20)]
    found = evaluate(payments + payments, customers=[("A", "a", 10, "dormant")])
    keys = ids(found, "txn_id", "rule_name")
    assert len(keys) == len(set(keys))
    assert {r for _, r in keys} == {"weekly_volume", "geographic", "dormant_reactivation"}


def test_one_hot_customer_gives_one_alert_per_rule_and_window(evaluate):
    payments = [txn(i, "HOT" if i % 3 else f"C{i}", 20000, f"2024-01-{1 + i % 28:02d} 10:00") for i in range(300)]
    found = evaluate(payments, only=["high_value"]).filter("customer_id = 'HOT'")
    assert found.count() == len({1 + i % 28 for i in range(300) if i % 3})


def test_batch_mode_uses_the_open_windows(make_txns, make_customers):
    txns = make_txns([txn(i, "A", 6000, f"2024-01-{d} 10:00") for i, d in [(1, 22), (2, 23), (3, 30)]])
    people = make_customers([])
    metrics = windows.window_metrics_asof(txns, "2024-01-30 23:59:59")
    found = rules.evaluate_rules(txns, metrics, people, flagged_at=F.col("ts"), per="batch", only=["weekly_volume"])
    assert ids(found) == []
    monthly = metrics.filter("window_type = 'monthly'").first()
    assert (monthly.txn_count, float(monthly.total_volume)) == (3, 18000.0)


def test_velocity_and_fanout(make_txns):
    burst = make_txns([txn(i, "A", 1, f"2024-01-10 10:0{i % 5}:0{i}", receiver=f"E{i}") for i in range(6)])
    found = rules.rule_velocity(burst).collect()
    assert [(r.account_id, r.txn_count) for r in found] == [("A", 6)]
    wide = make_txns([txn(i, "A", 1, "2024-01-10 10:00", receiver=f"E{i}") for i in range(21)])
    assert rules.rule_biweekly_fanout(windows.window_metrics(wide, AS_OF)).count() == 1


def test_rule_coverage_keeps_silent_rules_first(spark):
    flags = spark.createDataFrame([("smurfing", "2024-01-30")], "rule_name string, d string").select(
        "rule_name", F.to_timestamp("d").alias("flagged_at")
    )
    found = rules.rule_coverage(rules.scenario_catalog(spark), flags, AS_OF).collect()
    assert len(found) == 8 and found[-1].rule_name == "smurfing" and found[0].alerts_7d == 0
