from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows, txn
from tidewarden.operators import windows

AS_OF = "2024-01-31 12:00:00"


def test_repeated_payment_counts_once_and_null_receiver_is_no_receiver(make_txns):
    txns = make_txns(
        [
            txn(1, "A", 10, "2024-01-31 10:00", receiver="X"),
            txn(1, "A", 10, "2024-01-31 10:00", receiver="X"),
            txn(2, "A", 5, "2024-01-31 11:00", receiver="Y"),
            txn(3, "A", 5, "2024-01-31 11:30", receiver=None),
            txn(4, None, 5, "2024-01-31 11:30", receiver="X"),
        ]
    )
    daily = windows.window_metrics(txns, AS_OF).filter("window_type = 'daily'").collect()
    assert [(r.customer_id, r.total_volume, r.txn_count, r.distinct_receiver_count) for r in daily] == [("A", Decimal("20.00"), 3, 2)]


def test_roll_up_of_daily_facts_equals_direct_metrics(make_txns):
    txns = make_txns(
        [txn(i, f"C{i % 3}", i, f"2024-01-{1 + i % 31:02d} 0{i % 10}:00", receiver=f"R{i % 7}") for i in range(200)]
    )
    direct = windows.window_metrics(txns, AS_OF)
    rolled = windows.roll_up(windows.daily_facts(txns), AS_OF)
    assert rows(direct) == rows(rolled)


def test_asof_windows_equal_the_same_instances(make_txns):
    txns = make_txns(
        [txn(i, f"C{i % 3}", i, f"2024-01-{1 + i % 31:02d} 0{i % 10}:00", receiver=f"R{i % 7}") for i in range(200)]
    )
    asof = windows.window_metrics_asof(txns, AS_OF)
    every = windows.window_metrics(txns, AS_OF)
    assert rows(asof) == rows(every.join(asof.select("customer_id", "window_type", "window_start"), ["customer_id", "window_type", "window_start"]).select(*windows.METRIC_COLUMNS))


def test_asof_has_no_upper_bound(make_txns):
    txns = make_txns([txn(1, "A", 1, "2024-02-05 10:00")])
    assert windows.window_metrics_asof(txns, AS_OF).count() == 4


def test_behavior_takes_the_earliest_known_country(make_txns):
    txns = make_txns(
        [
            txn(1, "A", 1, "2024-01-10 10:00", sender_country=None, receiver="X"),
            txn(2, "A", 2, "2024-01-11 10:00", sender_country="FR", receiver="Y"),
            txn(3, "A", 3, "2024-01-12 10:00", sender_country="DE", receiver="X"),
            txn(4, "A", 9, "2023-12-01 10:00", sender_country="TR", receiver="Z"),
        ]
    )
    got = windows.behavior_30d(txns, AS_OF).first()
    assert (got.txn_count_30d, got.volume_30d, got.distinct_counterparties_30d, got.primary_sender_country) == (3, Decimal("6.00"), 2, "FR")


def test_spend_of_quiet_customer_is_absent(make_txns):
    txns = make_txns([txn(1, "A", 1, "2023-12-01 10:00")])
    assert windows.spend_30d(txns, AS_OF).count() == 0
    assert windows.behavior_30d(txns.filter(F.lit(False)), AS_OF).count() == 0
