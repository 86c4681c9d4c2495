"""Plan shapes that must hold at scale."""

import pytest

from conftest import DATA
from tidewarden.operators import alerts, gold, windows
from tidewarden.plans import registry
from tidewarden.plans.workspace import Workspace

# Lazy queries whose plans are looked at as a whole.
CHECKED = [
    "evaluate_rules", "window_metrics", "window_metrics_asof", "archive", "party_join", "for_customers",
    "open_alerts", "gold_customer_risk_profile", "geo_corridors", "dashboard_kpis", "customer_360",
    "resolve_targets", "dq_scorecard", "features", "upsert", "missing_addresses", "normalize", "sar_groups",
    "resolve_targets_all", "archive_heavy", "party_join_heavy", "burst_sessions", "alert_grid", "row_cap_large", "customer_txns_laid",
]


@pytest.fixture(scope="module")
def w(spark):
    return Workspace(spark, DATA)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_nested_loops_and_no_cross_joins(w, name):
    text = plan(registry.QUERIES[name](w))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(w):
    text = plan(registry.QUERIES["explorer_txn_high_value"](w))
    assert "GreaterThanOrEqual(amount_eur,5000.00)" in text
    scan = [line for line in text.splitlines() if "ReadSchema" in line][0]
    assert "sender_name" not in scan


def test_row_limits_are_applied_before_the_shuffle(w):
    text = plan(alerts.apply_budget(w.flags, alerts.flag_counts_24h(w.flags, w.as_of)))
    assert text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["live_txns"](w))


def test_hot_customers_are_combined_before_the_shuffle(w):
    text = plan(w.evaluated(only=["high_value", "weekly_volume"]))
    assert "partial_min" in text
    assert "partial_sum" in plan(windows.window_metrics(w.txns, w.as_of))


def test_fan_out_mart_never_joins_payments_with_alerts(w):
    text = plan(gold.gold_customer_risk_profile(w.txns, w.customers, w.flags, w.as_of))
    joins = [i for i, line in enumerate(text.splitlines()) if "Join" in line]
    aggregates = [i for i, line in enumerate(text.splitlines()) if "HashAggregate" in line]
    assert max(joins) < max(aggregates)


def test_a_page_reduces_the_table_it_is_joined_to(w):
    text = plan(alerts.recent_alerts(w.flags, w.dispositions, w.txns, 100))
    assert "LeftSemi" in text


def test_stored_tables_follow_the_configuration(spark, w):
    low = {**w.cfg, "high_value": {**w.cfg["high_value"], "threshold_eur": 1.0}}
    assert Workspace(spark, DATA, cfg=low).flags.count() > w.flags.count()
