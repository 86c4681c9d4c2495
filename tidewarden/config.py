"""Rule thresholds, catalogs and policies.

The values in this file are fixed: results depend on them.
"""

from __future__ import annotations

import copy
import json
import os
from decimal import Decimal

# Detection thresholds.
RULES = {
    "velocity": {"window_minutes": 5, "max_txns_per_account": 5, "min_txns_per_minute": 5},
    "high_value": {"threshold_eur": 10000},
    "geographic": {
        "blocked_countries": ["IR", "KP", "SY", "CU", "RU"],
        "high_risk_countries": ["RU", "KP"],
    },
    "multi_window": {
        "daily_velocity_max": 5,
        "daily_velocity_max_amount_eur": 1000,
        "weekly_volume_max_eur": 10000,
        "biweekly_distinct_receivers_max": 20,
        "monthly_peer_anomaly_multiplier": 2.5,
        "monthly_peer_baseline_txn_count": 8,
    },
    "smurfing": {"weekly_small_txn_threshold_eur": 500, "weekly_small_txn_count": 12},
    "dormant_reactivation": {"min_amount_eur": 3000},
    "mule_inbound": {"window_hours": 24, "min_distinct_senders": 5, "min_total_amount_eur": 500},
}

# Exchange rates to EUR; any other currency counts as EUR.
FX_TO_EUR = {
    "EUR": Decimal("1.000"),
    "USD": Decimal("0.920"),
    "TRY": Decimal("0.027"),
    "GBP": Decimal("1.170"),
    "CHF": Decimal("1.050"),
}

# Rule severity used by the alert priority.
RULE_SEVERITY = {
    "geographic": 90,
    "high_value": 85,
    "mule_inbound": 82,
    "smurfing": 80,
    "dormant_reactivation": 75,
    "weekly_volume": 70,
    "daily_velocity": 65,
    "monthly_peer_anomaly": 60,
}
OTHER_SEVERITY = 50

# The historic backfill knows no severity for these two rules.
BACKFILL_SEVERITY = {
    rule: severity
    for rule, severity in RULE_SEVERITY.items()
    if rule not in ("mule_inbound", "dormant_reactivation")
}

# Alert budget.
GLOBAL_ALERT_CAP = 100
RULE_ALERT_CAP = 12

# Know-your-customer score.
KYC_SEGMENT_POINTS = {"retail": 15, "premium": 30, "corporate": 45}
KYC_CHANNEL_POINTS = {"Branch": 0, "Mobile": 5, "Web": 10, "ATM": 15}
KYC_PEP_POINTS = 25
KYC_COUNTRY_POINTS = 10
KYC_HIGH_RISK_COUNTRIES = ["TR", "RU", "KP", "IR", "SY", "CU"]

# Address domain.
ADDRESS_TYPES = ["home", "work", "mailing", "billing", "branch"]
CITIES = [
    "Istanbul", "Ankara", "Izmir", "Berlin", "Munich",
    "Hamburg", "Paris", "Amsterdam", "Vienna", "Brussels",
]
ONBOARDING_CHANNELS = ["Mobile", "Branch", "Web", "ATM"]
COUNTRIES = ["DE", "TR", "FR", "NL", "AT", "BE", "IT", "ES", "PL", "CH"]

# Scenario catalog (id, rule, title, section of RULES, weight, most txns per injection, enabled).
SCENARIOS = [
    ("geo_high_risk", "geographic", "Geographic Risk Transfer", "geographic", 1.0, 1, True),
    ("high_value_outbound", "high_value", "High Value Outbound", "high_value", 1.0, 1, True),
    ("smurfing_fast", "smurfing", "Smurfing (Structured Payments)", "smurfing", 0.8, 12, True),
    ("daily_velocity_burst", "daily_velocity", "Daily Velocity Burst", "multi_window", 0.9, 6, True),
    ("weekly_volume_build", "weekly_volume", "Weekly Volume Buildup", "multi_window", 0.7, 1, True),
    ("monthly_peer_flood", "monthly_peer_anomaly", "Monthly Peer Anomaly", "multi_window", 0.6, 4, False),
    ("dormant_wake", "dormant_reactivation", "Dormant Account Reactivation", "dormant_reactivation", 0.85, 1, True),
    ("mule_inbound", "mule_inbound", "Mule Inbound Collection", "mule_inbound", 0.85, 6, True),
]

# Data-quality catalog (id, name, severity, category).
DQ_RULES = [
    ("DQ-001", "Sender identity → single country", "high", "party_consistency"),
    ("DQ-002", "Sender identity → single name", "high", "party_consistency"),
    ("DQ-003", "Receiver identity → single country", "high", "party_consistency"),
    ("DQ-004", "Receiver identity → single name", "medium", "party_consistency"),
    ("DQ-005", "Customer → stable branch", "medium", "party_consistency"),
    ("DQ-006", "EUR amount conversion", "medium", "financial"),
    ("DQ-007", "Required party fields", "high", "completeness"),
    ("DQ-008", "External sender without customer no", "medium", "completeness"),
]

# Retention policies (table, label, time column, value, unit).
RETENTION = [
    ("transactions", "Transactions", "ingested_at", 90, "days"),
    ("flagged_transactions", "Alerts (flagged)", "flagged_at", 180, "days"),
    ("sar_reports", "SAR reports", "created_at", 180, "days"),
    ("alert_transaction_archive", "Alert transaction archive", "archived_at", 180, "days"),
    ("account_window_metrics", "Account window metrics", "computed_at", 4, "hours"),
]
METRICS_ROW_CAP = 50_000

# Freshness limits in seconds (service, still ok, still stale).
FRESHNESS = [
    ("ingestion", 180, 600),
    ("scheduler", 2400, 7200),
    ("gold", 93600, 180000),
    ("onboarding", 129600, 259200),
    ("sar", 604800, 1209600),
    ("ml", 32400, 129600),
]

# Rule names a staged alert may carry.
ACCEPTED_RULES = [
    "geographic", "high_value", "smurfing", "daily_velocity", "weekly_volume",
    "monthly_peer_anomaly", "dormant_reactivation", "mule_inbound", "velocity",
]


def load_rules(path: str | None = None) -> dict:
    """Thresholds from a JSON or YAML file, each section merged over the defaults.

    A missing file gives the defaults; a section that is not a mapping replaces the default one.
    """
    merged = copy.deepcopy(RULES)
    if not path or not os.path.isfile(path):
        return merged
    with open(path) as handle:
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(handle) or {}
        else:
            given = json.load(handle)
    for section, values in given.items():
        if isinstance(values, dict) and isinstance(merged.get(section), dict):
            merged[section].update(values)
        else:
            merged[section] = values
    return merged
