"""The named queries as plain SQL over the given tables, to check results against another engine.

Shared steps are common table expressions; ``_sql`` prefixes a query with the ones it needs.
"""

from __future__ import annotations

import re

from tidewarden.plans import state_queries

AS_OF = "TIMESTAMP '2024-01-30 23:59:59'"
ACQ_AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
ONE = "'CUST-0000012'"

_DAY = f"{AS_OF} - INTERVAL 24 HOUR"
_COUNTRIES = "['DE','TR','FR','NL','AT','BE','IT','ES','PL','CH','RU','KP']"


def _key(n: str) -> str:
    return f"'CUST-' || lpad(CAST({n} AS VARCHAR), 7, '0')"


def _identity(n: str) -> str:
    return f"lpad(CAST({n} * 7654321 % 100000000000 AS VARCHAR), 11, '0')"


def _branch(n: str) -> str:
    return f"'BR-' || lpad(CAST(1 + {n} % 12 AS VARCHAR), 3, '0')"


def _start(ts: str, kind: str) -> str:
    if kind == "biweekly":
        day = f"CAST({ts} AS DATE)"
        into = f"((datediff('day', DATE '2026-01-01', {day}) % 14) + 14) % 14"
        return f"CAST({day} - CAST({into} AS INTEGER) AS TIMESTAMP)"
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[kind]
    return f"CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP)"


_WINDOWS = ["daily", "weekly", "biweekly", "monthly"]
_SEVERITY = (
    "CASE rule_name WHEN 'geographic' THEN 90 WHEN 'high_value' THEN 85 WHEN 'mule_inbound' THEN 82 "
    "WHEN 'smurfing' THEN 80 WHEN 'dormant_reactivation' THEN 75 WHEN 'weekly_volume' THEN 70 "
    "WHEN 'daily_velocity' THEN 65 WHEN 'monthly_peer_anomaly' THEN 60 ELSE 50 END"
)
_OLD_SEVERITY = (
    "CASE rule_name WHEN 'geographic' THEN 90 WHEN 'high_value' THEN 85 WHEN 'smurfing' THEN 80 "
    "WHEN 'weekly_volume' THEN 70 WHEN 'daily_velocity' THEN 65 WHEN 'monthly_peer_anomaly' THEN 60 ELSE 50 END"
)


def _priority(severity: str) -> str:
    return (
        f"CAST(round(0.6 * least({severity} + least(coalesce(f.amount_eur, f.amount, 0) * 0.002, 10), 100) "
        "+ 0.4 * coalesce(c.risk_score, 0), 2) AS DECIMAL(5,2))"
    )


def _flag(rule: str, source: str, window: str, detail: str, partition: str, where: str, customer="customer_id", account="coalesce(b.account, b.customer_id)") -> str:
    pick = (
        f"QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY b.ts DESC, b.txn_id) = 1" if partition else ""
    )
    return (
        f"SELECT b.txn_id, b.{customer} AS customer_id, {account} AS account_id, b.amount, b.currency, b.amount_eur, b.ts, "
        f"CAST(NULL AS VARCHAR) AS merchant, '{rule}' AS rule_name, {detail} AS rule_detail, "
        f"'{window}' AS window_type FROM {source} WHERE {where} {pick}"
    )


def _rule_parts(base: str, metrics: str, per_window: bool) -> list[str]:
    def tied(kind: str) -> str:
        on = f" AND m.window_start = {_start('b.ts', kind)}" if per_window else ""
        return f"{base} b JOIN {metrics} m ON m.customer_id = b.customer_id AND m.window_type = '{kind}'{on}"

    week = "b.customer_id" + (f", {_start('b.ts', 'weekly')}" if per_window else "")
    day = "b.customer_id" + (f", {_start('b.ts', 'daily')}" if per_window else "")
    month = "b.customer_id" + (f", {_start('b.ts', 'monthly')}" if per_window else "")
    mule_key = "receiver_customer_no" + (", CAST(ts AS DATE)" if per_window else "")
    inbound = "is_customer_receiver AND receiver_customer_no IS NOT NULL AND sender_customer_no IS NULL"
    mule = (
        f"(SELECT *, CAST(ts AS DATE) AS d FROM {base} WHERE {inbound} AND ({mule_key}) IN "
        f"(SELECT {mule_key} FROM {base} WHERE {inbound} GROUP BY {mule_key} "
        "HAVING count(DISTINCT sender_identity_no) >= 5)) b"
    )
    mule_part = "b.receiver_customer_no" + (", b.d" if per_window else "")
    return [
        _flag("weekly_volume", tied("weekly"), "weekly", "'weekly volume ' || CAST(m.total_volume AS VARCHAR) || ' EUR exceeds 10000.0'", week, "m.total_volume > 10000"),
        _flag("daily_velocity", tied("daily"), "daily", "'daily txn_count ' || CAST(m.txn_count AS VARCHAR) || ' exceeds 5 (txns <= 1000.0 EUR)'", day, "m.txn_count > 5 AND b.amount_eur <= 1000"),
        _flag("monthly_peer_anomaly", tied("monthly"), "monthly", "'monthly txn_count ' || CAST(m.txn_count AS VARCHAR) || ' exceeds peer baseline x2.5'", month, "m.txn_count > 20"),
        _flag("smurfing", tied("weekly"), "weekly", "'weekly activity >= 12 with txns under 500.0 EUR'", week, "m.txn_count >= 12 AND b.amount_eur <= 500"),
        _flag("geographic", f"{base} b", "daily", "'high-risk country: ' || b.first_country", day, "b.first_country IN ('IR','KP','SY','CU','RU')"),
        _flag("high_value", f"{base} b", "daily", "'amount_eur exceeds 10000.0 EUR'", day, "b.amount_eur > 10000"),
        _flag("dormant_reactivation", f"{base} b", "daily", "'dormant account activity >= 3000.0 EUR'", "", "b.amount_eur >= 3000 AND b.customer_id IN (SELECT customer_id FROM cust WHERE customer_status = 'dormant')"),
        _flag("mule_inbound", mule, "daily", "'distinct inbound senders >= 5'", mule_part, "true", "receiver_customer_no", "b.receiver_customer_no"),
    ]


_RULES = ["weekly_volume", "daily_velocity", "monthly_peer_anomaly", "smurfing", "geographic", "high_value", "dormant_reactivation", "mule_inbound"]

_TXN_FIELDS = (
    "txn_id, txn_category, txn_type, sender_id, receiver_id, sender_customer_no, receiver_customer_no, sender_name, "
    "receiver_name, sender_identity_no, receiver_identity_no, sender_branch, receiver_branch, sender_country, "
    "receiver_country, txn_description, branch_id"
)

_asof_windows = " UNION ALL ".join(
    f"SELECT *, '{w}' AS window_type, {_start(AS_OF, w)} AS window_start FROM facts WHERE ts >= {_start(AS_OF, w)}" for w in _WINDOWS
)
_all_windows = " UNION ALL ".join(f"SELECT *, '{w}' AS window_type, {_start('ts', w)} AS window_start FROM facts" for w in _WINDOWS)
_metric_select = (
    "SELECT s AS customer_id, window_type, CAST(sum(a) AS DECIMAL(18,2)) AS total_volume, count(*) AS txn_count, "
    f"count(DISTINCT r) AS distinct_receiver_count, window_start, {AS_OF} AS computed_at FROM (%s) GROUP BY s, window_type, window_start"
)

_CTE: dict[str, str] = {
    "cust": f"""
SELECT {_key('c_custkey')} AS customer_id, {_identity('c_custkey')} AS identity_no, c_name AS name,
       DATE '2024-01-31' - CAST(c_custkey * 17 % 1825 AS INTEGER) AS onboarding_date,
       ['Mobile','Branch','Web','ATM'][c_custkey % 4 + 1] AS onboarding_channel, segment, c_custkey % 25 = 0 AS is_pep,
       {_branch('c_custkey')} AS branch_id, country,
       CASE WHEN c_custkey % 20 = 0 THEN 'dormant' ELSE 'active' END AS customer_status,
       CAST(least(100, CASE segment WHEN 'corporate' THEN 45 WHEN 'premium' THEN 30 ELSE 15 END
         + CASE WHEN c_custkey % 25 = 0 THEN 25 ELSE 0 END
         + CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 10 ELSE 15 END
         + CASE WHEN country IN ('TR','RU','KP','IR','SY','CU') THEN 10 ELSE 0 END) AS DECIMAL(5,2)) AS risk_score,
       c_custkey AS g
FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'corporate' WHEN c_custkey % 7 = 0 THEN 'premium' ELSE 'retail' END AS segment,
             {_COUNTRIES}[c_custkey % 12 + 1] AS country FROM customer)""",
    "ev": """
SELECT event_id AS e, ts, user_id AS u, event_type AS kind, value, k, event_type = 'signup' AS inb,
       CASE WHEN event_type = 'signup' THEN k % 10 WHEN k % 4 = 0 THEN k END AS rn
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "wire": f"""
SELECT CAST(e AS VARCHAR) AS txn_id, e,
       CASE kind WHEN 'signup' THEN 'Cash' WHEN 'error' THEN 'BackOffice' ELSE 'Wire' END AS txn_category,
       CASE kind WHEN 'click' THEN 'FAST' WHEN 'view' THEN 'SEPA' WHEN 'purchase' THEN 'SWIFT' WHEN 'signup' THEN 'ATM_DEPOSIT' ELSE 'ADJUSTMENT' END AS txn_type,
       CASE WHEN NOT inb THEN {_key('u')} END AS sender_id,
       CASE WHEN rn IS NOT NULL THEN {_key('rn')} ELSE 'EXT-' || k END AS receiver_id,
       CASE WHEN NOT inb THEN {_key('u')} END AS sender_customer_no,
       CASE WHEN rn IS NOT NULL THEN {_key('rn')} END AS receiver_customer_no,
       CASE WHEN e % 89 = 0 THEN NULL WHEN e % 71 = 0 THEN 'Alias ' || u ELSE 'Customer ' || u END AS sender_name,
       CASE WHEN e % 61 = 0 THEN 'Ext alias ' || k WHEN rn IS NOT NULL THEN 'Customer ' || rn ELSE 'External ' || k END AS receiver_name,
       {_identity('u')} AS sender_identity_no,
       CASE WHEN rn IS NOT NULL THEN {_identity('rn')} ELSE '9' || lpad(CAST(k AS VARCHAR), 10, '0') END AS receiver_identity_no,
       CASE WHEN inb THEN NULL WHEN e % 79 = 0 THEN 'BR-099' ELSE {_branch('u')} END AS sender_branch,
       CASE WHEN rn IS NOT NULL THEN {_branch('rn')} END AS receiver_branch,
       {_COUNTRIES}[(u + CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END) % 12 + 1] AS sender_country,
       {_COUNTRIES}[(k + CASE WHEN e % 67 = 0 THEN 1 ELSE 0 END) % 10 + 1] AS receiver_country,
       CAST(NULL AS VARCHAR) AS txn_description, CAST(NULL AS VARCHAR) AS branch_id,
       CAST(round(CAST(value AS DECIMAL(18,2)) * 40, 2) AS DECIMAL(18,2)) AS amount,
       ['EUR','USD','TRY','GBP','CHF'][k % 5 + 1] AS currency,
       CAST(round(CAST(value AS DECIMAL(18,2)) * 40
         * CASE k % 5 WHEN 0 THEN CAST(1 AS DECIMAL(9,3)) WHEN 1 THEN CAST(0.92 AS DECIMAL(9,3)) WHEN 2 THEN CAST(0.027 AS DECIMAL(9,3))
                      WHEN 3 THEN CAST(1.17 AS DECIMAL(9,3)) ELSE CAST(1.05 AS DECIMAL(9,3)) END
         * CASE WHEN e % 83 = 0 THEN CAST(1.05 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END, 2) AS DECIMAL(18,2)) AS amount_eur,
       {_COUNTRIES}[(u + CASE WHEN e % 97 = 0 THEN 1 ELSE 0 END) % 12 + 1] AS country_code,
       NOT inb AS is_customer_sender, rn IS NOT NULL AS is_customer_receiver, ts,
       kind IN ('purchase','error','signup') AS is_synthetic_fraud
FROM ev""",
    "txn": """
SELECT txn_id, e, txn_category, txn_type, sender_id, receiver_id, sender_customer_no, receiver_id AS receiver_customer_no,
       sender_name, receiver_name, sender_identity_no, receiver_identity_no, coalesce(sender_branch, 'BR-001') AS sender_branch,
       receiver_branch, sender_country, receiver_country, txn_description, coalesce(sender_branch, 'BR-001') AS branch_id,
       amount, currency, amount_eur, country_code, is_customer_sender, is_customer_receiver, is_synthetic_fraud,
       CAST(NULL AS VARCHAR) AS fraud_type, ts, ts + INTERVAL 30 SECOND AS ingested_at
FROM wire""",
    "addr": """
SELECT g * 10 + n AS address_id, customer_id,
       ['Istanbul','Ankara','Izmir','Berlin','Munich','Hamburg','Paris','Amsterdam','Vienna','Brussels'][g % 10 + 1] AS city,
       'District ' || (1 + (g + n) % 20) AS district, country AS country_code,
       ['home','work','mailing','billing','branch'][(g + n) % 5 + 1] AS address_type
FROM (SELECT *, unnest(range(1, 2 + g % 5)) AS n FROM cust)""",
    "acq": f"SELECT {_key('o_custkey')} AS customer_id, min(o_orderdate) AS acquired_at FROM orders GROUP BY o_custkey",
    "elog": """
SELECT event_id AS id, ts, ['generator','spark','sar','ml','airflow'][user_id % 5 + 1] AS source,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL' ELSE 'WARNING' END AS level,
       event_type AS logger, event_type || ' ' || props AS message FROM events""",
    "jobs": """
SELECT 'job_' || user_id % 6 AS dag_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state,
       ts AS start_date, event_id AS run_id FROM events""",
    "facts": "SELECT DISTINCT sender_id AS s, receiver_id AS r, amount_eur AS a, ts FROM txn WHERE sender_id IS NOT NULL",
    "metrics": _metric_select % _all_windows,
    "asof_metrics": _metric_select % _asof_windows,
    "base": """
SELECT *, CASE WHEN is_customer_receiver AND receiver_customer_no IS NOT NULL THEN receiver_customer_no ELSE sender_customer_no END AS customer_id,
       sender_customer_no AS account, coalesce(sender_country, receiver_country, country_code) AS first_country FROM txn""",
    "batch": "SELECT * FROM base WHERE ts >= TIMESTAMP '2024-01-30' AND is_synthetic_fraud",
    "scoped": "SELECT * FROM base WHERE is_synthetic_fraud",
    "hits": " UNION ALL ".join(f"({p})" for p in _rule_parts("base", "metrics", True)),
    "flags": f"""
SELECT f.*, f.ts + INTERVAL 60 SECOND AS flagged_at, {_priority(_SEVERITY)} AS alert_priority_score
FROM hits f LEFT JOIN cust c ON c.customer_id = f.customer_id WHERE f.customer_id IS NOT NULL""",
    "disp": """
SELECT txn_id, rule_name, CASE WHEN CAST(txn_id AS BIGINT) % 2 = 0 THEN 'false_positive' ELSE 'sar_filed' END AS disposition,
       CAST(NULL AS VARCHAR) AS analyst_notes, flagged_at + INTERVAL 1 HOUR AS created_at
FROM flags WHERE CAST(txn_id AS BIGINT) % 5 = 0""",
    "reports": f"""
SELECT 'R-' || account_id AS report_id, substr(sha256(account_id), 1, 16) AS account_id_hash, account_id AS customer_id,
       count(*) AS flagged_count, 'earlier report' AS report_text, 'template' AS model_used, 'System' AS filed_by,
       {AS_OF} - INTERVAL 1 DAY AS created_at
FROM flags WHERE CAST(regexp_replace(account_id, '\\D', '', 'g') AS BIGINT) % 3 = 0 GROUP BY account_id""",
    "budgeted": f"""
SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY f.rule_name ORDER BY alert_priority_score DESC NULLS LAST, ts DESC, txn_id) AS rn,
    least(h.headroom, h.budget - h.before) AS cap
  FROM flags f JOIN (
    SELECT *, coalesce(sum(headroom) OVER (ORDER BY headroom DESC, rule_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT p.rule_name, 40 - coalesce(u.n, 0) AS headroom,
            greatest(0, 150 - (SELECT count(*) FROM flags WHERE flagged_at >= {_DAY} - INTERVAL 24 HOUR AND flagged_at < {_DAY})) AS budget
          FROM (SELECT DISTINCT rule_name FROM flags WHERE flagged_at >= {_DAY}) p
          LEFT JOIN (SELECT rule_name, count(*) AS n FROM flags WHERE flagged_at >= {_DAY} - INTERVAL 24 HOUR AND flagged_at < {_DAY} GROUP BY 1) u
            ON u.rule_name = p.rule_name)
    WHERE headroom > 0) h ON h.rule_name = f.rule_name
  WHERE f.flagged_at >= {_DAY})
WHERE rn <= cap""",
    "archived": f"""
SELECT f.txn_id AS alert_txn_id, f.rule_name, f.customer_id, f.flagged_at, {AS_OF} AS archived_at, t.txn_id, t.sender_customer_no,
       t.receiver_customer_no, t.amount_eur, t.ts, t.ingested_at AS txn_ingested_at
FROM budgeted f JOIN txn t ON f.customer_id = t.sender_customer_no OR f.customer_id = t.receiver_customer_no""",
    "spend": f"""
SELECT sender_id AS customer_id, count(*) AS txn_count_30d, CAST(sum(amount_eur) AS DOUBLE) AS volume_30d,
       CAST(sum(amount_eur) AS DOUBLE) / count(*) AS avg_amount_30d
FROM txn WHERE ts >= {AS_OF} - INTERVAL 30 DAY AND sender_id IS NOT NULL GROUP BY 1""",
    "behavior": f"""
SELECT sender_id AS customer_id, count(*) AS txn_count_30d, CAST(sum(amount_eur) AS DOUBLE) AS volume_30d,
       count(DISTINCT receiver_id) AS distinct_counterparties_30d, arg_min(sender_country, (ts, txn_id)) AS primary_sender_country,
       max(ts) AS last_txn_at, {AS_OF} AS computed_at
FROM txn WHERE ts >= {AS_OF} - INTERVAL 30 DAY AND sender_id IS NOT NULL GROUP BY 1""",
    "last_metrics": """
SELECT customer_id, window_type, total_volume, txn_count, distinct_receiver_count, window_start, computed_at FROM metrics
QUALIFY row_number() OVER (PARTITION BY customer_id, window_type ORDER BY computed_at DESC, window_start DESC) = 1""",
    "ctx": f"""
SELECT c.customer_id, c.name, c.risk_score, c.segment, coalesce(s.volume_30d, 0) AS volume_30d, coalesce(s.txn_count_30d, 0) AS txn_count_30d,
       coalesce(m.total_volume, 0) AS weekly_volume, coalesce(m.txn_count, 0) AS weekly_txn_count, coalesce(q.n, 0) AS weekly_fast_count
FROM cust c LEFT JOIN spend s USING (customer_id)
LEFT JOIN (SELECT * FROM last_metrics WHERE window_type = 'weekly') m USING (customer_id)
LEFT JOIN (SELECT sender_id AS customer_id, count(*) AS n FROM txn WHERE txn_type = 'FAST' AND ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1) q USING (customer_id)""",
    "briefs": """
SELECT f.txn_id, f.rule_name, f.rule_detail, f.customer_id, coalesce(x.txn_count_30d, 1) AS txn_count_30d,
  CASE WHEN x.name IS NULL THEN 'No context available for ' || f.customer_id || '.' ELSE
  'SAR INTELLIGENCE BRIEF' || chr(10) || 'Generated: 2024-01-30T23:59:59+00:00' || chr(10) || 'Customer: ' || x.name || ' (' || f.customer_id || ')' || chr(10)
  || 'Segment: ' || x.segment || ' | Risk score: ' || printf('%.1f', CAST(x.risk_score AS DOUBLE)) || chr(10)
  || '30-day volume: ' || format('{:,.2f}', CAST(x.volume_30d AS DOUBLE)) || ' EUR across ' || x.txn_count_30d || ' txns' || chr(10) || chr(10) || 'NARRATIVE' || chr(10)
  || CASE WHEN NOT (f.rule_name IN ('daily_velocity','geographic') OR x.weekly_fast_count >= 10 OR (f.rule_name = 'weekly_volume' AND x.weekly_volume > 10000))
     THEN '- Customer ' || f.customer_id || ' flagged under rule ''' || f.rule_name || ''' on txn ' || f.txn_id || '.'
     ELSE concat_ws(chr(10),
       CASE WHEN f.rule_name = 'weekly_volume' AND x.weekly_volume > 10000 THEN '- Customer ' || f.customer_id || ' exceeded weekly volume by '
         || printf('%.0f', (CAST(x.weekly_volume AS DOUBLE) - 10000) / 10000 * 100) || '% (' || format('{:,.2f}', CAST(x.weekly_volume AS DOUBLE)) || ' EUR vs threshold 10,000 EUR).' END,
       CASE WHEN x.weekly_fast_count >= 10 THEN '- Observed ' || x.weekly_fast_count || ' FAST transfers in 7 days (potential smurfing pattern).' END,
       CASE WHEN f.rule_name = 'daily_velocity' THEN '- Daily velocity rule triggered on alert ' || f.txn_id || '.' END,
       CASE WHEN f.rule_name = 'geographic' THEN '- Transaction involves high-risk jurisdiction.' END) END
  || chr(10) || chr(10) || 'Lineage: trace txn_id ' || f.txn_id || ' in aml.transactions → aml.flagged_transactions.' END AS brief
FROM flags f LEFT JOIN ctx x ON x.customer_id = f.customer_id""",
    "groups": """
SELECT account_id, substr(sha256(account_id), 1, 16) AS account_id_hash, count(*) AS cnt,
       string_agg(DISTINCT rule_name, ',' ORDER BY rule_name) AS rules, max(amount) AS max_amount
FROM flags GROUP BY account_id HAVING substr(sha256(account_id), 1, 16) NOT IN (SELECT account_id_hash FROM reports)""",
    "audit": "\nUNION ALL\n".join(
        f"""SELECT 'alerts_24h_' || rule_name AS metric_key, count(*) AS metric_value, rule_name AS metric_detail, {t} AS recorded_at FROM flags WHERE flagged_at >= {t} - INTERVAL 24 HOUR GROUP BY rule_name
UNION ALL SELECT 'alerts_24h_total', count(*), NULL, {t} FROM flags WHERE flagged_at >= {t} - INTERVAL 24 HOUR
UNION ALL SELECT 'customers_total', count(*), NULL, {t} FROM cust
UNION ALL SELECT 'customers_active', count(*), NULL, {t} FROM cust WHERE customer_status = 'active'
UNION ALL SELECT 'customers_acquired_today', count(*), NULL, {t} FROM acq WHERE acquired_at >= date_trunc('day', {t})"""
        for t in (AS_OF, f"({AS_OF} - INTERVAL 1 HOUR)")
    ),
    "feat": f"""
SELECT a.*, CAST(coalesce(c.risk_score, 0) AS DOUBLE) AS kyc_risk_score, CASE WHEN c.is_pep THEN 1 ELSE 0 END AS is_pep, coalesce(f.n, 0) AS flag_count_30d
FROM (SELECT sender_id AS customer_id, count(*) AS txn_count_30d, CAST(sum(amount_eur) AS DOUBLE) AS volume_30d,
        CAST(sum(amount_eur) AS DOUBLE) / count(*) AS avg_amount_30d, CAST(max(amount_eur) AS DOUBLE) AS max_txn_30d,
        stddev_pop(CAST(amount_eur AS DOUBLE)) AS std_amount_30d, count(DISTINCT receiver_customer_no) AS distinct_receivers_30d,
        count(DISTINCT receiver_country) AS distinct_countries_30d, count(*) FILTER (WHERE receiver_country <> 'DE') AS cross_border_txns,
        CAST(count(*) FILTER (WHERE receiver_country <> 'DE') AS DOUBLE) / count(*) AS cross_border_ratio,
        count(*) FILTER (WHERE txn_type = 'FAST') AS fast_txns
      FROM txn WHERE ts >= {AS_OF} - INTERVAL 30 DAY AND sender_id IS NOT NULL GROUP BY 1) a
LEFT JOIN cust c USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM flags WHERE flagged_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1) f USING (customer_id)""",
    "labelled": """
SELECT *, customer_id IN (SELECT customer_id FROM flags WHERE rule_name IN ('high_value','daily_velocity')) AS rule_flagged FROM feat""",
    "scores": """
SELECT customer_id, 'v1' AS model_version, round((ln(1 + volume_30d) - lo) / (hi - lo), 5) AS anomaly_score,
       row_number() OVER (ORDER BY volume_30d DESC, customer_id) AS anomaly_rank, ln(1 + volume_30d) > cut AS is_anomaly,
       CAST(NULL AS DOUBLE) AS triage_score, rule_flagged, txn_count_30d, volume_30d, distinct_receivers_30d, max_txn_30d, kyc_risk_score
FROM labelled, (SELECT min(ln(1 + volume_30d)) AS lo, max(ln(1 + volume_30d)) AS hi, quantile_cont(ln(1 + volume_30d), 0.95) AS cut FROM labelled)""",
    "steps": """
SELECT thr, pos, neg, sum(pos) OVER (ORDER BY thr DESC) AS tp, sum(neg) OVER (ORDER BY thr DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
       row_number() OVER (ORDER BY thr DESC) AS i, lead(pos) OVER (ORDER BY thr DESC) AS next_pos, lead(neg) OVER (ORDER BY thr DESC) AS next_neg
FROM (SELECT anomaly_score AS thr, count(*) FILTER (WHERE rule_flagged) AS pos, count(*) FILTER (WHERE NOT rule_flagged) AS neg FROM scores GROUP BY 1)""",
    "prc": """
SELECT CAST(tp AS DOUBLE) / (tp + fp) AS "precision", CAST(tp AS DOUBLE) / p AS recall, thr AS threshold FROM steps""",
}


def _needs(sql: str) -> list[str]:
    found: list[str] = []
    for name in _CTE:
        if re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", sql):
            for deeper in _needs(_CTE[name]):
                if deeper not in found:
                    found.append(deeper)
            if name not in found:
                found.append(name)
    return found


def _sql(body: str) -> str:
    ctes = _needs(body)
    if not ctes:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n]})" for n in ctes) + "\n" + body


def _d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n.split('.')[-1]}" for n in names)


_SINCE30 = f"{AS_OF} - INTERVAL 30 DAY"
_FLAG_OUT = (
    f"txn_id, customer_id, account_id, {_d('amount')}, currency, {_d('amount_eur')}, ts, merchant, rule_name, rule_detail, "
    "window_type, ts + INTERVAL 60 SECOND AS flagged_at"
)
_TXN_OUT = (
    f"{_TXN_FIELDS}, {_d('amount')}, currency, {_d('amount_eur')}, country_code, is_customer_sender, is_customer_receiver, "
    "is_synthetic_fraud, fraud_type, ts, ingested_at"
)
_TXN_PAGE = (
    "txn_id, txn_category, txn_type, sender_customer_no, receiver_customer_no, sender_name, receiver_name, sender_identity_no, "
    "receiver_identity_no, sender_branch, receiver_branch, sender_country, receiver_country, txn_description, branch_id, "
    f"{_d('amount')}, currency, {_d('amount_eur')}, country_code, ts, ingested_at"
)
_CUST_OUT = (
    "customer_id, identity_no, name, CAST(onboarding_date AS VARCHAR) AS onboarding_date, onboarding_channel, segment, is_pep, branch_id, country, customer_status, "
    + _d("risk_score")
)
_METRIC_OUT = f"customer_id, window_type, {_d('total_volume')}, txn_count, distinct_receiver_count, window_start, computed_at"
_OPEN = "(SELECT f.* FROM flags f LEFT JOIN disp d ON d.txn_id = f.txn_id AND d.rule_name = f.rule_name WHERE d.txn_id IS NULL)"
_OPEN_COLS = (
    "f.txn_id AS alert_id, f.customer_id, f.rule_name, f.flagged_at, CAST(f.alert_priority_score AS DOUBLE) AS alert_priority_score, "
    "c.name AS customer_name, CAST(c.risk_score AS DOUBLE) AS kyc_risk_score"
)
_PER_K = "round(1000.0 * coalesce(a.n, 0) / nullif(t.n, 0), 2)"


def _segmentation(dim: str) -> str:
    if dim == "txn_type":
        volume = "SELECT txn_type AS dim, count(*) AS n, sum(amount_eur) AS v FROM txn WHERE ts >= {s} GROUP BY 1"
        alert = "SELECT t.txn_type AS dim, count(*) AS n FROM flags f JOIN txn t ON t.txn_id = f.txn_id WHERE f.flagged_at >= {s} GROUP BY 1"
    else:
        volume = f"SELECT c.{dim} AS dim, count(*) AS n, sum(t.amount_eur) AS v FROM txn t JOIN cust c ON c.customer_id = t.sender_id WHERE t.ts >= {{s}} GROUP BY 1"
        alert = f"SELECT c.{dim} AS dim, count(*) AS n FROM flags f JOIN cust c ON c.customer_id = f.customer_id WHERE f.flagged_at >= {{s}} GROUP BY 1"
    return (
        f"SELECT t.dim, t.n AS txn_count, CAST(t.v AS DOUBLE) AS volume, coalesce(a.n, 0) AS alert_count, CAST({_PER_K} AS DOUBLE) AS alerts_per_1k "
        f"FROM ({volume.format(s=_SINCE30)}) t LEFT JOIN ({alert.format(s=_SINCE30)}) a ON a.dim = t.dim WHERE t.dim IS NOT NULL"
    )


def _incidence(expr: str, name: str) -> str:
    return (
        f"SELECT {expr} AS {name}, count(*) AS active_customers, count(al.customer_id) AS flagged_customers, "
        "CAST(round(100.0 * count(al.customer_id) / nullif(count(*), 0), 2) AS DOUBLE) AS incidence_pct "
        f"FROM (SELECT DISTINCT sender_id AS customer_id FROM txn WHERE ts >= {_SINCE30}) a JOIN cust c USING (customer_id) "
        f"LEFT JOIN (SELECT DISTINCT customer_id FROM flags WHERE flagged_at >= {_SINCE30}) al USING (customer_id) GROUP BY 1"
    )


def _profile(flag_join: str, flag_count: str) -> str:
    return (
        f"SELECT t.sender_id AS customer_id, c.name, c.segment, CAST(c.risk_score AS DOUBLE) AS risk_score, c.is_pep, count(*) AS txn_count_30d, "
        "CAST(sum(t.amount) AS DOUBLE) AS volume_30d, count(DISTINCT t.receiver_id) AS distinct_receivers_30d, CAST(max(t.amount) AS DOUBLE) AS max_txn_30d, "
        f"{flag_count} AS flag_count_30d FROM txn t JOIN cust c ON c.customer_id = t.sender_id {flag_join} WHERE t.ts >= {_SINCE30} "
        "GROUP BY t.sender_id, c.name, c.segment, c.risk_score, c.is_pep"
    )


def _dq_identity(identity: str, attribute: str, sep: str) -> str:
    return (
        f"SELECT {identity} AS entity_id, count(DISTINCT {attribute}) AS distinct_values, "
        f"string_agg(DISTINCT left({attribute}, 40), '{sep}' ORDER BY left({attribute}, 40)) AS values_seen FROM txn "
        f"WHERE {identity} IS NOT NULL AND {attribute} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {attribute}) > 1"
    )


_DQ = {
    "DQ-001": _dq_identity("sender_identity_no", "sender_country", ", "),
    "DQ-002": _dq_identity("sender_identity_no", "sender_name", " | "),
    "DQ-003": _dq_identity("receiver_identity_no", "receiver_country", ", "),
    "DQ-004": _dq_identity("receiver_identity_no", "receiver_name", " | "),
    "DQ-005": " UNION ALL ".join(
        f"SELECT {s}_customer_no AS entity_id, count(DISTINCT {s}_branch) AS distinct_values, 'branch mismatch' AS values_seen FROM txn "
        f"WHERE {s}_customer_no IS NOT NULL AND {s}_branch IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {s}_branch) > 1"
        for s in ("sender", "receiver")
    ),
    "DQ-006": (
        f"SELECT txn_id AS entity_id, currency, {_d('amount', 'amount_eur')}, round(dev * 100, 2) AS distinct_values FROM "
        "(SELECT *, CAST(abs(amount_eur - amount * CASE currency WHEN 'USD' THEN 0.92 WHEN 'TRY' THEN 0.027 WHEN 'GBP' THEN 1.17 WHEN 'CHF' THEN 1.05 ELSE 1 END) AS DOUBLE) "
        "/ nullif(CAST(amount_eur AS DOUBLE), 0) AS dev FROM txn WHERE amount > 0) WHERE dev > 0.01"
    ),
    "DQ-007": (
        "SELECT txn_id AS entity_id, 1 AS distinct_values, concat_ws(', ', "
        + ", ".join(
            f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END"
            for c in ("sender_name", "sender_identity_no", "receiver_name", "receiver_identity_no")
        )
        + ") AS values_seen FROM txn WHERE coalesce(sender_name, '') = '' OR coalesce(sender_identity_no, '') = '' "
        "OR coalesce(receiver_name, '') = '' OR coalesce(receiver_identity_no, '') = ''"
    ),
    "DQ-008": (
        "SELECT txn_id AS entity_id, 1 AS distinct_values, 'missing external sender fields' AS values_seen FROM txn "
        "WHERE sender_customer_no IS NULL AND (coalesce(sender_name, '') = '' OR coalesce(sender_identity_no, '') = '')"
    ),
}
_DQ_CATALOG = [
    ("DQ-001", "Sender identity → single country", "high", "party_consistency"),
    ("DQ-002", "Sender identity → single name", "high", "party_consistency"),
    ("DQ-003", "Receiver identity → single country", "high", "party_consistency"),
    ("DQ-004", "Receiver identity → single name", "medium", "party_consistency"),
    ("DQ-005", "Customer → stable branch", "medium", "party_consistency"),
    ("DQ-006", "EUR amount conversion", "medium", "financial"),
    ("DQ-007", "Required party fields", "high", "completeness"),
    ("DQ-008", "External sender without customer no", "medium", "completeness"),
]
_SCENARIOS = (
    "(VALUES ('geo_high_risk','geographic','Geographic Risk Transfer',1.0,true,2), ('high_value_outbound','high_value','High Value Outbound',1.0,true,1), "
    "('smurfing_fast','smurfing','Smurfing (Structured Payments)',0.8,true,2), ('daily_velocity_burst','daily_velocity','Daily Velocity Burst',0.9,true,6), "
    "('weekly_volume_build','weekly_volume','Weekly Volume Buildup',0.7,true,6), ('monthly_peer_flood','monthly_peer_anomaly','Monthly Peer Anomaly',0.6,false,6), "
    "('dormant_wake','dormant_reactivation','Dormant Account Reactivation',0.85,true,1), ('mule_inbound','mule_inbound','Mule Inbound Collection',0.85,true,3)) "
    "s(scenario_id, rule_name, title, priority_weight, enabled, thresholds)"
)
_AGE = f"greatest(CAST(floor((epoch_us({AS_OF}) - epoch_us({{t}})) / 60000000.0) AS BIGINT), 0)"


def _age_label(ts: str) -> str:
    m = _AGE.format(t=ts)
    return f"CASE WHEN {m} < 60 THEN {m} || 'm ago' WHEN {m} < 1440 THEN {m} // 60 || 'h ago' ELSE {m} // 1440 || 'd ago' END"


def _test_row(model: str, column: str, test: str, count_sql: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{column}' AS column_name, '{test}' AS test_name, n AS failures, "
        f"CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({count_sql})"
    )


_ACCOUNT_SCORE = (
    "SELECT account_id, count(*) AS total_flags, count(DISTINCT rule_name) AS distinct_rules, CAST(max(amount) AS DOUBLE) AS max_flagged_amount, "
    "max(flagged_at) AS last_flagged_at, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS risk_tier FROM flags GROUP BY account_id"
)
_FANOUT = f"LEFT JOIN flags f ON f.customer_id = t.sender_id AND f.flagged_at >= {_SINCE30}"
_RETAINED = [
    ("transactions", "txn", "ingested_at", "14 DAY", "90 days", "Transactions"),
    ("flagged_transactions", "flags", "flagged_at", "180 DAY", "180 days", "Alerts (flagged)"),
    ("sar_reports", "reports", "created_at", "180 DAY", "180 days", "SAR reports"),
    ("alert_transaction_archive", "archived", "archived_at", "180 DAY", "180 days", "Alert transaction archive"),
    ("account_window_metrics", "metrics", "computed_at", "4 HOUR", "4 hours", "Account window metrics"),
]

_BODY: dict[str, str] = {
    "parse_txn_json": (
        f"SELECT txn_id, sender_id, receiver_id, {_d('amount')}, currency, {_d('amount_eur')}, is_customer_receiver, ts, CAST(NULL AS VARCHAR) AS merchant "
        "FROM wire WHERE e % 50 <> 0 AND e % 60 <> 1"
    ),
    "split_bad_records": (
        "SELECT count(*) FILTER (WHERE e % 50 <> 0 AND e % 60 <> 1) AS good_records, count(*) FILTER (WHERE e % 50 = 0 OR e % 60 = 1) AS bad_records FROM wire"
    ),
    "read_table": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000",
    "history": f"SELECT txn_id, ts, {_d('amount_eur')} FROM txn WHERE ts >= {AS_OF} - INTERVAL 7 DAY",
    "insert_new": "SELECT txn_id, ts FROM txn WHERE ts >= TIMESTAMP '2024-01-20'",
    "prune_runs": (
        f"SELECT table_name, count(*) FILTER (WHERE u < {AS_OF} - INTERVAL 7 DAY) AS deleted, count(*) FILTER (WHERE u >= {AS_OF} - INTERVAL 7 DAY) AS kept "
        "FROM (SELECT 'gold_' || event_type AS table_name, CAST(ts AS DATE) AS d, max(ts) AS u FROM events GROUP BY 1, 2) GROUP BY 1"
    ),
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}"
        for n, t in [
            ("transactions", "txn"), ("customers", "cust"), ("customer_addresses", "addr"),
            ("account_window_metrics", "metrics"), ("flagged_transactions", "flags"), ("alert_dispositions", "disp"),
        ]
    ),
    "normalize_parties": (
        "SELECT txn_id, sender_id, sender_id AS sender_customer_no, receiver_id, receiver_id AS receiver_customer_no FROM wire"
    ),
    "apply_defaults": (
        "SELECT txn_id, txn_category, txn_type, coalesce(sender_branch, 'BR-001') AS branch_id, coalesce(sender_branch, 'BR-001') AS sender_branch, "
        "country_code, currency FROM wire"
    ),
    "to_eur": (
        f"SELECT txn_id, {_d('amount')}, currency, CASE WHEN e % 3 = 0 THEN CAST(amount * CASE currency WHEN 'USD' THEN 0.92 WHEN 'TRY' THEN 0.027 "
        "WHEN 'GBP' THEN 1.17 WHEN 'CHF' THEN 1.05 ELSE 1 END AS DOUBLE) ELSE CAST(amount_eur AS DOUBLE) END AS amount_eur FROM wire"
    ),
    "project_txn": f"SELECT {_TXN_OUT} FROM txn",
    "scope": "SELECT txn_id, txn_type FROM txn WHERE is_synthetic_fraud",
    "alert_subject": "SELECT txn_id, customer_id FROM base",
    "dedupe_txns": f"SELECT DISTINCT sender_id, receiver_id, {_d('amount_eur')}, ts AS event_ts FROM txn",
    "dedupe_by": f"SELECT txn_id, {_d('amount_eur')}, ts FROM txn",
    "backfill_parties": (
        "SELECT txn_id, coalesce(sender_branch, 'BR-001') AS sender_branch, sender_country, receiver_country, txn_type || ' — ' || txn_category AS txn_description FROM wire"
    ),
    "backfill_customers": (
        "SELECT customer_id, CAST(CASE WHEN g % 3 <> 0 THEN onboarding_date ELSE DATE '2024-01-15' END AS VARCHAR) AS onboarding_date, "
        "CASE WHEN customer_id BETWEEN 'CUST-0000201' AND 'CUST-0000250' THEN 'dormant' ELSE customer_status END AS customer_status, "
        "true AS has_channel, true AS has_country, 11 AS identity_length, CASE WHEN g % 4 <> 0 THEN onboarding_channel END AS kept_channel, "
        "CASE WHEN g % 5 <> 0 THEN identity_no END AS kept_identity FROM cust"
    ),
    "fill_blank": (
        "SELECT report_id, CASE WHEN n % 2 = 0 OR n % 9 = 0 THEN 'System' ELSE 'Analyst' END AS filed_by "
        "FROM (SELECT *, CAST(regexp_replace(customer_id, '\\D', '', 'g') AS BIGINT) AS n FROM reports)"
    ),
    "mask_identity": (
        "SELECT txn_id, left(sender_identity_no, 3) || '****' || right(sender_identity_no, 2) AS sender_masked, "
        "CASE WHEN receiver_branch IS NULL THEN '—' ELSE left(receiver_branch, 3) || '****' || right(receiver_branch, 2) END AS branch_masked FROM txn"
    ),
    "hash_id": "SELECT txn_id, CASE WHEN sender_id IS NULL THEN '—' ELSE substr(sha256(sender_id), 1, 16) END AS sender_hash FROM txn",
    "format_transactions": (
        "SELECT txn_id, txn_category, txn_type, coalesce(sender_branch, '—') AS sender_branch, coalesce(receiver_branch, '—') AS receiver_branch, "
        "coalesce(sender_country, '—') AS sender_country, coalesce(receiver_country, '—') AS receiver_country, coalesce(sender_customer_no, '—') AS sender_customer_no, "
        "coalesce(receiver_customer_no, '—') AS receiver_customer_no, left(sender_identity_no, 3) || '****' || right(sender_identity_no, 2) AS sender_id_no, "
        "left(receiver_identity_no, 3) || '****' || right(receiver_identity_no, 2) AS receiver_id_no, "
        "format('{:,.2f}', CAST(amount AS DOUBLE)) || ' ' || currency AS trx_amount, format('{:,.2f}', CAST(amount_eur AS DOUBLE)) AS eur_amount FROM txn"
    ),
    "format_alerts": (
        "SELECT f.txn_id, f.rule_name AS rule, f.window_type AS \"window\", format('{:,.0f}', CAST(f.amount AS DOUBLE)) || ' ' || f.currency AS amount, "
        "'€' || format('{:,.0f}', CAST(f.amount_eur AS DOUBLE)) AS eur, coalesce(t.sender_country, '—') || ' → ' || coalesce(t.receiver_country, t.country_code, '—') AS route, "
        f"coalesce(t.sender_name, 'External') AS sender, coalesce(t.receiver_name, '—') AS receiver, {_age_label('f.flagged_at')} AS flagged, left(f.rule_detail, 60) AS detail "
        "FROM flags f LEFT JOIN txn t ON t.txn_id = f.txn_id"
    ),
    "relative_age": f"SELECT txn_id, {_age_label('ts')} AS age FROM txn",
    "human_bytes": (
        "SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.0f', s) || ' B' WHEN s / 1024 < 1024 THEN printf('%.1f', s / 1024) || ' KB' "
        "WHEN s / 1024**2 < 1024 THEN printf('%.1f', s / 1024**2) || ' MB' WHEN s / 1024**3 < 1024 THEN printf('%.1f', s / 1024**3) || ' GB' "
        "WHEN s / 1024**4 < 1024 THEN printf('%.1f', s / 1024**4) || ' TB' ELSE printf('%.1f', s / 1024**5) || ' PB' END AS size "
        "FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * pow(32.0, doc_id % 10) AS s FROM documents)"
    ),
    "enrich_kyc": (
        "SELECT t.txn_id, t.sender_id AS anchor_customer_id, c.name AS cust_name, c.segment AS cust_segment, c.customer_status AS cust_status, "
        "CAST(c.risk_score AS DOUBLE) AS cust_risk_score, a.city AS cust_city, a.district AS cust_district, a.country_code AS cust_country_code "
        "FROM txn t LEFT JOIN cust c ON c.customer_id = t.sender_id LEFT JOIN (SELECT * FROM addr WHERE address_type = 'home' "
        "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY address_id) = 1) a ON a.customer_id = t.sender_id"
    ),
    "primary_address": (
        "SELECT customer_id, city, district, country_code FROM addr WHERE address_type = 'home' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY address_id) = 1"
    ),
    "party_join": (
        "SELECT f.customer_id, t.txn_id AS party_txn_id, CAST(t.amount_eur AS DOUBLE) AS amount_eur FROM (SELECT DISTINCT customer_id FROM flags WHERE rule_name = 'high_value') f "
        "JOIN txn t ON f.customer_id = t.sender_customer_no OR f.customer_id = t.receiver_customer_no"
    ),
    "for_customers": (
        "SELECT txn_id, sender_customer_no, receiver_customer_no FROM txn WHERE sender_customer_no IN (SELECT customer_id FROM cust WHERE customer_status = 'dormant') "
        "OR receiver_customer_no IN (SELECT customer_id FROM cust WHERE customer_status = 'dormant')"
    ),
    "missing_addresses": (
        "SELECT c.customer_id, c.country AS country_code, t.address_type FROM cust c, (VALUES ('home'), ('work')) t(address_type) "
        "WHERE NOT EXISTS (SELECT 1 FROM addr a WHERE a.customer_id = c.customer_id AND a.address_type = t.address_type)"
    ),
    "address_expand": "SELECT address_id, customer_id, city, district, country_code, address_type FROM addr",
    "window_start": "SELECT txn_id, " + ", ".join(f"{_start('ts', w)} AS {w}" for w in _WINDOWS) + " FROM txn",
    "window_metrics_asof": f"SELECT {_METRIC_OUT} FROM asof_metrics",
    "window_metrics": f"SELECT {_METRIC_OUT} FROM metrics",
    "behavior_30d": "SELECT * FROM behavior",
    "spend_30d": "SELECT customer_id, txn_count_30d, volume_30d, round(avg_amount_30d, 4) AS avg_amount_30d FROM spend",
    "customer_flags_30d": (
        f"SELECT customer_id, rule_name, window_type, count(*) AS cnt, max(flagged_at) AS last_flagged FROM flags WHERE flagged_at >= {_SINCE30} GROUP BY 1, 2, 3"
    ),
    "latest_window_metrics": f"SELECT {_METRIC_OUT} FROM last_metrics",
    "rule_velocity": (
        "SELECT sender_id AS account_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS txn_count, 'velocity' AS rule_name "
        "FROM txn WHERE sender_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 5"
    ),
    "rule_velocity_strict": (
        "SELECT sender_id AS account_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS txn_count, 'velocity' AS rule_name "
        "FROM txn WHERE sender_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
    ),
    "rule_biweekly_fanout": (
        "SELECT customer_id, window_start, distinct_receiver_count, 'biweekly_receivers' AS rule_name FROM metrics WHERE window_type = 'biweekly' AND distinct_receiver_count > 20"
    ),
    "evaluate_rules": f"SELECT {_FLAG_OUT} FROM hits WHERE customer_id IS NOT NULL",
    "scenario_catalog": (
        "SELECT scenario_id, s.rule_name, title, CAST(priority_weight AS DOUBLE) AS priority_weight, enabled, 7 AS active_scenarios, thresholds, coalesce(n, 0) AS alerts "
        f"FROM {_SCENARIOS} LEFT JOIN (SELECT rule_name, count(*) AS n FROM flags GROUP BY 1) f ON f.rule_name = s.rule_name"
    ),
    "rule_coverage": (
        f"SELECT scenario_id, s.rule_name, enabled, coalesce(n, 0) AS alerts_7d FROM {_SCENARIOS} LEFT JOIN (SELECT rule_name, count(*) AS n FROM flags "
        f"WHERE flagged_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1) f ON f.rule_name = s.rule_name"
    ),
    "flag_counts_24h": (
        f"SELECT rule_name, count(*) AS alert_count FROM flags WHERE flagged_at >= {_DAY} GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM flags WHERE flagged_at >= {_DAY}"
    ),
    "apply_budget": f"SELECT {_FLAG_OUT}, {_d('alert_priority_score')} FROM budgeted",
    "alert_priority": f"SELECT txn_id, rule_name, customer_id, {_d('alert_priority_score')} FROM flags",
    "backfill_priority": (
        f"SELECT f.txn_id, f.rule_name, CAST({_priority(_OLD_SEVERITY)} AS DOUBLE) AS alert_priority_score FROM flags f LEFT JOIN cust c ON c.customer_id = f.customer_id"
    ),
    "archive": (
        "SELECT alert_txn_id, rule_name, customer_id, flagged_at, archived_at, txn_id, sender_customer_no, receiver_customer_no, "
        f"{_d('amount_eur')}, ts, txn_ingested_at FROM archived"
    ),
    "archive_for": (
        f"SELECT txn_id, rule_name, alert_txn_id, {_d('amount_eur')}, ts FROM archived WHERE (alert_txn_id, rule_name) IN "
        "(SELECT (txn_id, rule_name) FROM budgeted ORDER BY flagged_at DESC, txn_id, rule_name LIMIT 1)"
    ),
    "archive_counts": (
        "SELECT alert_txn_id, rule_name, customer_id, count(*) AS archived_txns, min(archived_at) AS first_archived FROM archived GROUP BY 1, 2, 3"
    ),
    "open_alerts": (
        f"SELECT {_OPEN_COLS} FROM {_OPEN} f LEFT JOIN cust c ON c.customer_id = f.customer_id "
        "ORDER BY f.alert_priority_score DESC NULLS LAST, f.flagged_at DESC, f.txn_id, f.rule_name LIMIT 25 OFFSET 10"
    ),
    "recent_alerts": (
        f"SELECT {_OPEN_COLS} FROM {_OPEN} f LEFT JOIN cust c ON c.customer_id = f.customer_id ORDER BY f.flagged_at DESC, f.txn_id, f.rule_name LIMIT 20"
    ),
    "recent_alerts_detail": (
        f"SELECT f.txn_id, f.customer_id, f.account_id, {_d('f.amount', 'f.amount_eur')}, f.currency, f.rule_name, f.rule_detail, f.window_type, f.flagged_at, "
        "t.txn_category, t.txn_type, t.country_code, t.sender_customer_no, t.receiver_customer_no, t.sender_name, t.receiver_name, t.sender_identity_no, "
        "t.receiver_identity_no, t.sender_branch, t.receiver_branch, t.sender_country, t.receiver_country, t.txn_description "
        f"FROM {_OPEN} f LEFT JOIN txn t ON t.txn_id = f.txn_id ORDER BY f.flagged_at DESC, f.txn_id, f.rule_name LIMIT 100"
    ),
    "record_disposition": (
        "SELECT txn_id, rule_name, CASE WHEN CAST(txn_id AS BIGINT) % 10 = 0 THEN 'sar_filed' ELSE disposition END AS disposition, "
        "CASE WHEN CAST(txn_id AS BIGINT) % 10 = 0 THEN 'second look' END AS analyst_notes, "
        "CASE WHEN CAST(txn_id AS BIGINT) % 10 = 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS created_at FROM disp"
    ),
    "archived_alerts": (
        "SELECT d.txn_id AS alert_id, d.rule_name, d.disposition, CASE d.disposition WHEN 'sar_filed' THEN 'SAR filed' WHEN 'false_positive' THEN 'White flag' ELSE d.disposition END AS outcome, "
        "d.analyst_notes, d.created_at AS archived_at, c.name AS customer_name, f.flagged_at FROM disp d JOIN flags f ON f.txn_id = d.txn_id AND f.rule_name = d.rule_name "
        "LEFT JOIN cust c ON c.customer_id = f.customer_id ORDER BY d.created_at DESC, d.txn_id, d.rule_name LIMIT 50 OFFSET 10"
    ),
    "alert_counts": (
        "SELECT count(*) FILTER (WHERE d.txn_id IS NULL) AS open_alerts, count(*) FILTER (WHERE d.txn_id IS NOT NULL) AS dispositioned "
        "FROM flags f LEFT JOIN disp d ON d.txn_id = f.txn_id AND d.rule_name = f.rule_name"
    ),
    "disposition_counts": "SELECT disposition, count(*) AS cnt FROM disp GROUP BY 1",
    "customer_alerts": f"SELECT {_OPEN_COLS} FROM {_OPEN} f LEFT JOIN cust c ON c.customer_id = f.customer_id WHERE f.customer_id = {ONE}",
    "customer_alerts_30d": (
        f"SELECT txn_id, rule_name, rule_detail, window_type, flagged_at FROM flags WHERE customer_id = {ONE} AND flagged_at >= {_SINCE30}"
    ),
    "alert_by_txn": (
        f"SELECT f.txn_id, f.rule_name, f.customer_id, {_d('f.amount_eur')}, t.txn_category, t.txn_type, t.country_code, t.receiver_id, t.sender_country, t.receiver_country "
        "FROM flags f LEFT JOIN txn t ON t.txn_id = f.txn_id QUALIFY row_number() OVER (PARTITION BY f.txn_id ORDER BY f.rule_name) = 1"
    ),
    "alert_disposition": "SELECT * FROM disp",
    "alert_for_payment": (
        f"SELECT f.txn_id, f.rule_name, f.customer_id, {_d('f.amount_eur')}, t.txn_category, t.txn_type, t.country_code, t.receiver_id, t.sender_country, t.receiver_country "
        "FROM flags f LEFT JOIN txn t ON t.txn_id = f.txn_id WHERE f.txn_id = (SELECT min(txn_id) FROM flags) ORDER BY f.rule_name LIMIT 1"
    ),
    "disposition_for_alert": "SELECT disposition, analyst_notes, created_at FROM disp ORDER BY txn_id, rule_name LIMIT 1",
    "sar_groups": f"SELECT account_id, account_id_hash, cnt, rules, {_d('max_amount')} FROM groups ORDER BY cnt DESC, account_id LIMIT 20",
    "new_sar_groups": f"SELECT account_id, account_id_hash, cnt, rules, {_d('max_amount')} FROM groups",
    "render_sar": (
        "SELECT 'SAR-' || substr(sha256(account_id_hash || '|2024-01-30T23:59:59+00:00'), 1, 32) AS report_id, account_id_hash, cnt AS flagged_count, 'SUSPICIOUS ACTIVITY REPORT (MOCK)' || chr(10) || 'Report Date: 2024-01-30T23:59:59+00:00' || chr(10) || "
        "'Subject Account (hashed): ' || account_id_hash || chr(10) || chr(10) || 'Summary: ' || cnt || ' transaction(s) flagged under rule(s): ' || replace(rules, ',', ', ') || "
        "'. Maximum observed amount: ' || CAST(max_amount AS VARCHAR) || ' EUR.' || chr(10) || chr(10) || 'Recommendation: Escalate to compliance officer for enhanced due diligence. "
        f"Consider temporary account monitoring and source-of-funds verification.' AS report_text, 'mock' AS model_used, 'System' AS filed_by, {AS_OF} AS created_at FROM groups"
    ),
    "sar_context": (
        f"SELECT customer_id, name, {_d('risk_score')}, segment, {_d('volume_30d')}, txn_count_30d, {_d('weekly_volume')}, weekly_txn_count, weekly_fast_count FROM ctx"
    ),
    "intelligence_brief": "SELECT txn_id, rule_name, brief FROM briefs",
    "file_sar": (
        "SELECT 'SAR-' || substr(sha256(txn_id || '|' || rule_name), 1, 32) AS report_id, substr(sha256(customer_id), 1, 16) AS account_id_hash, customer_id, "
        "greatest(txn_count_30d, 1) AS flagged_count, sha256('Filed by: Analyst One' || chr(10) || 'Filed at: 2024-01-30T23:59:59+00:00' || chr(10) || chr(10) || brief || chr(10) || chr(10) || "
        "'FULL REPORT' || chr(10) || repeat('=', 40) || chr(10) || 'Rule: ' || rule_name || chr(10) || 'Detail: ' || rule_detail || chr(10) || 'Subject hash: ' || substr(sha256(customer_id), 1, 16) "
        f"|| chr(10) || 'Recommendation: Escalate to compliance officer for EDD review.') AS text_hash, 'sar_intelligence' AS model_used, 'Analyst One' AS filed_by, {AS_OF} AS created_at "
        "FROM briefs WHERE rule_name = 'high_value'"
    ),
    "sar_reports": (
        "SELECT report_id, customer_id, flagged_count, report_text, filed_by, created_at FROM reports ORDER BY created_at DESC, report_id LIMIT 15 OFFSET 5"
    ),
    "explorer_sar_recent": "SELECT report_id, customer_id, flagged_count, model_used, created_at FROM reports ORDER BY created_at DESC, report_id LIMIT 15",
    "stg_flagged": f"SELECT txn_id, account_id, {_d('amount')}, currency, ts, merchant, rule_name, rule_detail, flagged_at FROM flags",
    "gold_daily_fraud_summary": (
        "SELECT CAST(CAST(flagged_at AS DATE) AS VARCHAR) AS report_date, rule_name, count(*) AS flag_count, count(DISTINCT account_id) AS distinct_accounts, CAST(sum(amount) AS DOUBLE) AS total_flagged_amount FROM flags GROUP BY 1, 2"
    ),
    "gold_account_risk_score": _ACCOUNT_SCORE,
    "gold_customer_risk_profile": _profile(_FANOUT, "count(f.txn_id)"),
    "gold_customer_risk_profile_dedup": _profile(
        f"LEFT JOIN (SELECT customer_id, count(*) AS n FROM flags WHERE flagged_at >= {_SINCE30} GROUP BY 1) f ON f.customer_id = t.sender_id", "coalesce(max(f.n), 0)"
    ),
    "dashboard_kpis": (
        f"SELECT (SELECT count(*) FROM flags) AS total_alerts, (SELECT count(*) FROM flags WHERE flagged_at >= {_DAY}) AS alerts_24h, "
        "(SELECT count(*) FROM txn WHERE ingested_at >= TIMESTAMP '2024-01-30') AS txns_today, (SELECT count(*) FROM cust) AS customers"
    ),
    "summary_metrics": (
        "SELECT (SELECT count(*) FROM txn) AS total_ingested, (SELECT count(*) FROM flags) AS total_flagged, (SELECT count(*) FROM reports) AS total_sar"
    ),
    "risk_bands": (
        "SELECT CASE WHEN risk_score < 50 THEN 'low_risk' WHEN risk_score < 75 THEN 'medium_risk' ELSE 'high_risk' END AS risk_band, count(*) AS customer_count FROM cust GROUP BY 1"
    ),
    "risk_bands_explorer": (
        "SELECT CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS customers FROM cust GROUP BY 1"
    ),
    "alerts_by_rule": "SELECT rule_name, count(*) AS alert_count FROM flags GROUP BY 1",
    "alerts_by_rule_24h": f"SELECT rule_name, count(*) AS alert_count FROM flags WHERE flagged_at >= {_DAY} GROUP BY 1",
    "alerts_by_rule_hourly": (
        f"SELECT rule_name, date_trunc('hour', flagged_at) AS hour_bucket, count(*) AS alert_count FROM flags WHERE flagged_at >= {_DAY} GROUP BY 1, 2"
    ),
    "txn_trend": f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS txn_count, CAST(sum(amount_eur) AS DOUBLE) AS volume_eur FROM txn WHERE ts >= {_SINCE30} GROUP BY 1",
    "alert_trend": (
        f"SELECT CAST(t.day AS VARCHAR) AS day, coalesce(a.n, 0) AS alerts, t.n AS txns, CAST({_PER_K} AS DOUBLE) AS alerts_per_1k FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM txn WHERE ts >= {_SINCE30} GROUP BY 1) t "
        f"LEFT JOIN (SELECT CAST(flagged_at AS DATE) AS day, count(*) AS n FROM flags WHERE flagged_at >= {_SINCE30} GROUP BY 1) a ON a.day = t.day"
    ),
    "acquisition_trend": (
        "SELECT CAST(CAST(l.acquired_at AS DATE) AS VARCHAR) AS day, coalesce(c.onboarding_channel, 'Unknown') AS channel, count(*) AS new_customers FROM acq l LEFT JOIN cust c ON c.customer_id = l.customer_id "
        f"WHERE l.acquired_at >= {ACQ_AS_OF} - INTERVAL 3650 DAY GROUP BY 1, 2"
    ),
    "segmentation_segment": _segmentation("segment"),
    "segmentation_channel": _segmentation("onboarding_channel"),
    "segmentation_txn_type": _segmentation("txn_type"),
    "geo_corridors": (
        "SELECT t.sender_country, t.receiver_country, count(*) AS txn_count, CAST(sum(t.amount_eur) AS DOUBLE) AS volume, count(f.txn_id) AS alert_count FROM txn t "
        f"LEFT JOIN flags f ON f.txn_id = t.txn_id WHERE t.ts >= {_SINCE30} AND t.sender_country <> t.receiver_country GROUP BY 1, 2 ORDER BY volume DESC, 1, 2 LIMIT 12"
    ),
    "risk_incidence": _incidence(
        "CASE WHEN c.risk_score >= 75 THEN 'High (75-100)' WHEN c.risk_score >= 50 THEN 'Medium (50-74)' WHEN c.risk_score >= 25 THEN 'Low (25-49)' ELSE 'Minimal (0-24)' END", "band"
    ),
    "pep_incidence": _incidence("c.is_pep", "is_pep"),
    "priority_by_rule": (
        f"SELECT rule_name, CAST(round(sum(alert_priority_score) * 1.0 / count(*), 1) AS DOUBLE) AS avg_priority, count(*) AS alerts FROM flags WHERE flagged_at >= {_SINCE30} GROUP BY 1"
    ),
    "customer_360": (
        f"SELECT c.customer_id, c.name, c.onboarding_channel, c.segment, c.is_pep, c.branch_id, c.country, c.customer_status, {_d('c.risk_score')}, coalesce(s.txn_count_30d, 0) AS txn_count_30d, "
        "coalesce(s.volume_30d, 0) AS volume_30d, coalesce(s.avg_amount_30d, 0) AS avg_amount_30d, coalesce(f.n, 0) AS flags_30d, f.last_flagged, "
        + ", ".join(
            f"coalesce(CAST(max(m.total_volume) FILTER (WHERE m.window_type = '{w}') AS DOUBLE), 0) AS {w}_total_volume, coalesce(max(m.txn_count) FILTER (WHERE m.window_type = '{w}'), 0) AS {w}_txn_count"
            for w in _WINDOWS
        )
        + f" FROM cust c LEFT JOIN spend s USING (customer_id) LEFT JOIN (SELECT customer_id, count(*) AS n, max(flagged_at) AS last_flagged FROM flags WHERE flagged_at >= {_SINCE30} GROUP BY 1) f USING (customer_id) "
        "LEFT JOIN last_metrics m USING (customer_id) GROUP BY ALL"
    ),
    "recent_sent": (
        f"SELECT txn_id, txn_category, txn_type, {_d('amount')}, currency, {_d('amount_eur')}, receiver_customer_no, receiver_name, sender_branch, receiver_branch, sender_country, receiver_country, "
        f"txn_description, country_code, ts FROM txn WHERE sender_id = {ONE} ORDER BY ts DESC, txn_id LIMIT 20"
    ),
    "search_customers": (
        f"SELECT customer_id, name, {_d('risk_score')}, segment, is_pep, branch_id, CAST(onboarding_date AS VARCHAR) AS onboarding_date, onboarding_channel, customer_status, identity_no FROM cust "
        "WHERE customer_id ILIKE '%00001%' OR name ILIKE '%00001%' ORDER BY customer_id LIMIT 20"
    ),
    "resolve_targets": (
        "SELECT q, CASE WHEN cid IS NOT NULL THEN 'customer' WHEN f.txn_id IS NOT NULL THEN 'alert' ELSE 'customer' END AS mode, coalesce(cid, f.customer_id, nm) AS customer_id, "
        "CASE WHEN cid IS NULL THEN f.txn_id END AS txn_id, CASE WHEN cid IS NULL THEN f.rule_name END AS rule_name FROM (SELECT q, "
        "(SELECT min(customer_id) FROM cust WHERE customer_id = q AND upper(q) LIKE 'CUST-%') AS cid, "
        "(SELECT min(customer_id) FROM cust WHERE customer_id ILIKE '%' || q || '%' OR name ILIKE '%' || q || '%') AS nm FROM ("
        "SELECT customer_id AS q FROM cust WHERE g % 50 = 0 UNION SELECT txn_id FROM wire WHERE e % 500 = 0 UNION SELECT right(name, 5) FROM cust WHERE g % 70 = 0)) t "
        "LEFT JOIN (SELECT * FROM flags QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY flagged_at DESC, rule_name) = 1) f ON f.txn_id = q "
        "WHERE cid IS NOT NULL OR f.txn_id IS NOT NULL OR nm IS NOT NULL"
    ),
    "resolve_targets_all": (
        "SELECT q, CASE WHEN cid IS NOT NULL THEN 'customer' WHEN f.txn_id IS NOT NULL THEN 'alert' ELSE 'customer' END AS mode, coalesce(cid, f.customer_id, nm) AS customer_id, "
        "CASE WHEN cid IS NULL THEN f.txn_id END AS txn_id, CASE WHEN cid IS NULL THEN f.rule_name END AS rule_name FROM (SELECT q, "
        "(SELECT min(customer_id) FROM cust WHERE customer_id = q AND upper(q) LIKE 'CUST-%') AS cid, "
        "(SELECT min(customer_id) FROM cust WHERE customer_id ILIKE '%' || q || '%' OR name ILIKE '%' || q || '%') AS nm FROM ("
        "SELECT customer_id AS q FROM cust UNION SELECT txn_id FROM wire UNION SELECT right(name, 5) FROM cust)) t "
        "LEFT JOIN (SELECT * FROM flags QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY flagged_at DESC, rule_name) = 1) f ON f.txn_id = q "
        "WHERE cid IS NOT NULL OR f.txn_id IS NOT NULL OR nm IS NOT NULL"
    ),
    "customer_txns": f"SELECT {_TXN_PAGE} FROM txn WHERE sender_id = {ONE} OR receiver_customer_no = {ONE} ORDER BY ts DESC, txn_id LIMIT 100",
    "customer_txns_30d": f"SELECT {_TXN_PAGE} FROM txn WHERE (sender_id = {ONE} OR receiver_customer_no = {ONE}) AND ts >= {_SINCE30}",
    "live_txns": f"SELECT {_TXN_PAGE} FROM txn ORDER BY ingested_at DESC, txn_id LIMIT 25 OFFSET 50",
    "customer_addresses": f"SELECT address_id, city, district, country_code, address_type FROM addr WHERE customer_id = {ONE}",
    "customer_by_id": f"SELECT {_CUST_OUT} FROM cust WHERE customer_id = {ONE}",
    "active_customers": f"SELECT {_CUST_OUT} FROM cust WHERE customer_status = 'active'",
    "behavior_by_id": f"SELECT * FROM behavior WHERE customer_id = {ONE}",
    "next_customer_id": "SELECT 'CUST-' || lpad(CAST(max(g) + 1 AS VARCHAR), 7, '0') AS next_customer_id FROM cust",
    "kyc_risk_score": f"SELECT customer_id, {_d('risk_score')} FROM cust",
    "explorer_txn_latest": f"SELECT txn_id, sender_customer_no, receiver_customer_no, {_d('amount_eur')}, currency, ingested_at FROM txn ORDER BY ingested_at DESC, txn_id LIMIT 20",
    "explorer_txn_high_value": (
        f"SELECT txn_id, sender_customer_no, CAST(t.amount_eur AS DOUBLE) AS amount_eur, currency, ts FROM txn t WHERE t.amount_eur >= 5000 ORDER BY t.amount_eur DESC, txn_id LIMIT 15"
    ),
    "explorer_txn_by_country": "SELECT sender_country, count(*) AS txns, CAST(sum(amount_eur) AS DOUBLE) AS volume_eur FROM txn WHERE sender_country IS NOT NULL GROUP BY 1 ORDER BY volume_eur DESC, 1 LIMIT 10",
    "explorer_cust_pep": (
        "SELECT customer_id, name, CAST(c.risk_score AS DOUBLE) AS risk_score, segment, country FROM cust c WHERE is_pep ORDER BY c.risk_score DESC, customer_id LIMIT 20"
    ),
    "explorer_cust_addresses": "SELECT customer_id, count(*) AS address_count FROM addr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "explorer_cust_acquired": "SELECT CAST(CAST(acquired_at AS DATE) AS VARCHAR) AS day, count(*) AS new_customers FROM acq GROUP BY 1 ORDER BY 1 DESC LIMIT 14",
    "explorer_alert_hourly": f"SELECT date_trunc('hour', flagged_at) AS hour, count(*) AS alerts FROM flags WHERE flagged_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1",
    "explorer_alert_archive": (
        "SELECT alert_txn_id, rule_name, customer_id, count(*) AS archived_txns, min(archived_at) AS first_archived FROM archived GROUP BY 1, 2, 3 ORDER BY first_archived DESC, 1, 2 LIMIT 20"
    ),
    "explorer_alert_priority": "SELECT rule_name, CAST(round(sum(alert_priority_score) * 1.0 / count(*), 1) AS DOUBLE) AS avg_priority, count(*) AS alerts FROM flags GROUP BY 1",
    "explorer_pipe_metrics": "SELECT metric_key, metric_value, recorded_at FROM audit ORDER BY recorded_at DESC, metric_key LIMIT 20",
    "explorer_pipe_windows": "SELECT window_type, count(*) AS \"rows\", max(computed_at) AS latest FROM metrics GROUP BY 1",
    "explorer_pipe_behavior": "SELECT customer_id, txn_count_30d, volume_30d, last_txn_at FROM behavior ORDER BY volume_30d DESC NULLS LAST, customer_id LIMIT 15",
    "dq_sender_country": _DQ["DQ-001"],
    "dq_sender_name": _DQ["DQ-002"],
    "dq_receiver_country": _DQ["DQ-003"],
    "dq_receiver_name": _DQ["DQ-004"],
    "dq_branch": _DQ["DQ-005"],
    "dq_fx": _DQ["DQ-006"],
    "dq_required": _DQ["DQ-007"],
    "dq_external_sender": _DQ["DQ-008"],
    "dq_scorecard": " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, '{label}' AS rule_label, '{sev}' AS severity, '{cat}' AS category, n AS violation_count, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status "
        f"FROM (SELECT count(*) AS n FROM ({_DQ[i]}))"
        for i, label, sev, cat in _DQ_CATALOG
    ),
    "schema_tests": " UNION ALL ".join(
        [
            _test_row("stg_flagged_transactions", "txn_id", "not_null", "SELECT count(*) AS n FROM flags WHERE txn_id IS NULL"),
            _test_row("stg_flagged_transactions", "rule_name", "not_null", "SELECT count(*) AS n FROM flags WHERE rule_name IS NULL"),
            _test_row("stg_flagged_transactions", "rule_name", "accepted_values", "SELECT count(*) AS n FROM flags WHERE rule_name NOT IN ('geographic','high_value','smurfing','daily_velocity','weekly_volume','monthly_peer_anomaly','dormant_reactivation','mule_inbound','velocity')"),
            _test_row("gold_account_risk_score", "account_id", "not_null", f"SELECT count(*) AS n FROM ({_ACCOUNT_SCORE}) WHERE account_id IS NULL"),
            _test_row("gold_account_risk_score", "account_id", "unique", f"SELECT count(*) AS n FROM (SELECT account_id FROM ({_ACCOUNT_SCORE}) GROUP BY 1 HAVING count(*) > 1)"),
            _test_row("gold_account_risk_score", "risk_tier", "accepted_values", f"SELECT count(*) AS n FROM ({_ACCOUNT_SCORE}) WHERE risk_tier NOT IN ('low','medium','high')"),
            _test_row("gold_customer_risk_profile", "customer_id", "not_null", f"SELECT count(*) AS n FROM ({_profile(_FANOUT, 'count(f.txn_id)')}) WHERE customer_id IS NULL"),
            _test_row("gold_customer_risk_profile", "customer_id", "unique", f"SELECT count(*) AS n FROM (SELECT customer_id FROM ({_profile(_FANOUT, 'count(f.txn_id)')}) GROUP BY 1 HAVING count(*) > 1)"),
            _test_row("transactions", "sender_name", "not_null", "SELECT count(*) AS n FROM txn WHERE sender_name IS NULL"),
            _test_row("transactions", "sender_name", "unique", "SELECT count(*) AS n FROM (SELECT sender_name FROM txn WHERE sender_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"),
        ]
    ),
    "pipeline_audit": f"SELECT * FROM audit WHERE recorded_at = {AS_OF}",
    "latest_metrics": "SELECT * FROM audit QUALIFY row_number() OVER (PARTITION BY metric_key ORDER BY recorded_at DESC) = 1",
    "consistency_checks": (
        "SELECT metric_key, live, snapshot, abs(live - snapshot) AS diff, abs(live - snapshot) <= CASE metric_key WHEN 'customers_total' THEN greatest(5, floor(live * 0.0001)) ELSE 1 END AS ok "
        "FROM (SELECT 'customers_total' AS metric_key, count(*) AS live FROM cust UNION ALL SELECT 'customers_acquired_today', count(*) FROM acq WHERE acquired_at >= TIMESTAMP '2024-01-30') "
        f"JOIN (SELECT metric_key, metric_value AS snapshot FROM audit WHERE recorded_at = {AS_OF}) USING (metric_key)"
    ),
    "freshness": (
        "SELECT service, last_seen, CAST(date_diff('second', date_trunc('second', last_seen), "
        f"{AS_OF}) AS DOUBLE) AS age_sec, CASE WHEN last_seen IS NULL THEN 'down' WHEN date_diff('second', date_trunc('second', last_seen), {AS_OF}) <= ok THEN 'ok' "
        f"WHEN date_diff('second', date_trunc('second', last_seen), {AS_OF}) <= stale THEN 'stale' ELSE 'down' END AS status FROM ("
        "SELECT 'ingestion' AS service, max(ingested_at) AS last_seen, 180 AS ok, 600 AS stale FROM txn UNION ALL SELECT 'scheduler', max(start_date), 2400, 7200 FROM jobs "
        "UNION ALL SELECT 'gold', max(flagged_at), 93600, 180000 FROM flags UNION ALL SELECT 'onboarding', max(acquired_at), 129600, 259200 FROM acq "
        "UNION ALL SELECT 'sar', max(created_at), 604800, 1209600 FROM reports UNION ALL SELECT 'ml', CAST(NULL AS TIMESTAMP), 32400, 129600)"
    ),
    "throughput": (
        "SELECT (SELECT count(*) FROM txn WHERE ingested_at >= TIMESTAMP '2024-01-30') AS txns_today, "
        f"(SELECT count(*) FROM txn WHERE ingested_at >= {AS_OF} - INTERVAL 5 MINUTE) AS txns_5m, (SELECT count(*) FROM flags WHERE flagged_at >= {_DAY}) AS alerts_24h"
    ),
    "job_health": (
        f"SELECT dag_id, max(start_date) AS last_start, arg_max(state, (start_date, run_id)) AS last_state, count(*) FILTER (WHERE start_date >= {_DAY}) AS runs_24h, "
        f"count(*) FILTER (WHERE start_date >= {_DAY} AND state = 'failed') AS failed_24h, max(start_date) FILTER (WHERE state = 'success') AS last_success FROM jobs GROUP BY 1"
    ),
    "apply_retention": f"SELECT txn_id, ingested_at FROM txn WHERE ingested_at >= {AS_OF} - INTERVAL 14 DAY",
    "retention_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) FILTER (WHERE {c} >= {AS_OF} - INTERVAL {i}) AS kept, count(*) FILTER (WHERE {c} < {AS_OF} - INTERVAL {i}) AS deleted FROM {t}"
        for n, t, c, i, _r, _l in _RETAINED
    ),
    "row_cap": (
        "SELECT customer_id, window_type, window_start, txn_count FROM metrics ORDER BY computed_at DESC, window_start DESC, customer_id, window_type LIMIT 500"
    ),
    "retention_report": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{label}' AS label, '{r}' AS retention, count(*) AS row_count FROM {t}" for n, t, _c, _i, r, label in _RETAINED
    ),
    "log_summary": (
        f"SELECT count(*) FILTER (WHERE level IN ('ERROR','CRITICAL')) AS err_24h, count(*) FILTER (WHERE level = 'WARNING') AS warn_24h, count(*) AS total_24h FROM elog WHERE ts >= {_DAY}"
    ),
    "log_by_source": f"SELECT source, level, count(*) AS cnt FROM elog WHERE ts >= {_DAY} GROUP BY 1, 2",
    "log_sources": "SELECT DISTINCT source FROM elog",
    "log_search": (
        f"SELECT * FROM elog WHERE ts >= {AS_OF} - INTERVAL 240 HOUR AND level IN ('ERROR','CRITICAL') AND source IN ('spark','ml') AND (message ILIKE '%PURCHASE%' OR logger ILIKE '%PURCHASE%') "
        "ORDER BY ts DESC, id LIMIT 100"
    ),
    "log_histogram": "SELECT date_trunc('hour', ts) AS bucket, level, count(*) AS cnt FROM elog GROUP BY 1, 2",
    "features": (
        "SELECT customer_id, txn_count_30d, volume_30d, round(avg_amount_30d, 6) AS avg_amount_30d, max_txn_30d, round(std_amount_30d, 6) AS std_amount_30d, distinct_receivers_30d, "
        "distinct_countries_30d, cross_border_txns, round(cross_border_ratio, 6) AS cross_border_ratio, fast_txns, kyc_risk_score, is_pep, flag_count_30d, flag_count_30d > 0 AS rule_flagged FROM feat"
    ),
    "feature_matrix": (
        "SELECT customer_id, CAST(txn_count_30d AS DOUBLE) AS txn_count_30d, round(ln(1 + volume_30d), 6) AS volume_30d, round(ln(1 + avg_amount_30d), 6) AS avg_amount_30d, "
        "round(ln(1 + max_txn_30d), 6) AS max_txn_30d, round(ln(1 + std_amount_30d), 6) AS std_amount_30d, CAST(distinct_receivers_30d AS DOUBLE) AS distinct_receivers_30d, "
        "CAST(distinct_countries_30d AS DOUBLE) AS distinct_countries_30d, CAST(cross_border_txns AS DOUBLE) AS cross_border_txns, round(cross_border_ratio, 6) AS cross_border_ratio, "
        "CAST(fast_txns AS DOUBLE) AS fast_txns, kyc_risk_score, CAST(is_pep AS DOUBLE) AS is_pep FROM feat"
    ),
    "normalize": (
        "SELECT customer_id, round((ln(1 + volume_30d) - lo) / (hi - lo), 6) AS anomaly_score FROM labelled, (SELECT min(ln(1 + volume_30d)) AS lo, max(ln(1 + volume_30d)) AS hi FROM labelled)"
    ),
    "anomaly_rank": "SELECT customer_id, anomaly_rank, is_anomaly FROM scores",
    "score_snapshot": "SELECT * FROM scores",
    "roc_auc": "SELECT CAST(round(sum(CAST(neg AS DOUBLE) * (2 * tp - pos)) / (2.0 * sum(pos) * sum(neg)), 4) AS DOUBLE) AS roc_auc FROM steps",
    "average_precision": "SELECT round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos), 4) AS pr_auc FROM steps",
    "roc_curve": (
        "SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, CAST(NULL AS DOUBLE) AS threshold UNION ALL SELECT round(CAST(fp AS DOUBLE) / n, 9), round(CAST(tp AS DOUBLE) / p, 9), thr FROM steps "
        "WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"
    ),
    "pr_curve": (
        "SELECT round(\"precision\", 9) AS \"precision\", round(recall, 9) AS recall, threshold FROM prc UNION ALL SELECT 1.0::DOUBLE, 0.0::DOUBLE, NULL"
    ),
    "downsample": (
        "SELECT position, customer_id FROM (SELECT row_number() OVER (ORDER BY volume_30d, customer_id) - 1 AS position, customer_id, count(*) OVER () AS m FROM scores) "
        "WHERE m <= 200 OR position IN (SELECT i * (m - 1) // 199 FROM range(200) r(i))"
    ),
    "best_threshold": (
        "SELECT threshold, round(\"precision\", 4) AS precision_score, round(recall, 4) AS recall_score, round(f1, 4) AS f1_score "
        "FROM (SELECT *, round(2 * \"precision\" * recall / (\"precision\" + recall + 1e-12), 12) AS f1 FROM prc) ORDER BY f1 DESC, threshold LIMIT 1"
    ),
    "ml_overlap": (
        "SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly AND rule_flagged) AS \"both\", count(*) FILTER (WHERE is_anomaly AND NOT rule_flagged) AS ml_only, "
        "count(*) FILTER (WHERE NOT is_anomaly AND rule_flagged) AS rule_only, count(*) FILTER (WHERE NOT is_anomaly AND NOT rule_flagged) AS neither FROM scores"
    ),
    "ml_overlap_groups": "SELECT rule_flagged, is_anomaly, count(*) AS customers FROM scores GROUP BY 1, 2",
    "crosstab": "SELECT rule_flagged, count(*) FILTER (WHERE NOT is_anomaly) AS normal, count(*) FILTER (WHERE is_anomaly) AS anomaly FROM scores GROUP BY 1",
    "top_anomalies": (
        "SELECT s.customer_id, s.anomaly_score, s.anomaly_rank, s.is_anomaly, s.triage_score, s.rule_flagged, s.txn_count_30d, s.volume_30d, s.distinct_receivers_30d, s.max_txn_30d, s.kyc_risk_score, "
        "c.name AS customer_name FROM scores s LEFT JOIN cust c ON c.customer_id = s.customer_id ORDER BY s.anomaly_score DESC NULLS LAST, s.customer_id LIMIT 20"
    ),
    "ml_only": (
        "SELECT customer_id, anomaly_score, triage_score, txn_count_30d, volume_30d FROM scores WHERE is_anomaly AND NOT rule_flagged ORDER BY anomaly_score DESC, customer_id LIMIT 20"
    ),
    "score_histogram": (
        "SELECT CAST(least(floor(anomaly_score * 40), 39) AS INTEGER) AS bin, rule_flagged, count(*) AS customers FROM scores GROUP BY 1, 2"
    ),
}

_BODY["stratified_folds"] = (
    "SELECT rule_flagged, fold, count(*) AS customers FROM (SELECT rule_flagged, (row_number() OVER (ORDER BY rule_flagged, customer_id) - 1) % 5 AS fold FROM labelled) GROUP BY 1, 2"
)
_BODY["stratified_split"] = (
    "SELECT rule_flagged, is_test, count(*) AS customers FROM (SELECT rule_flagged, row_number() OVER (PARTITION BY rule_flagged ORDER BY customer_id) "
    "<= round(count(*) OVER (PARTITION BY rule_flagged) * 0.3) AS is_test FROM labelled) GROUP BY 1, 2"
)
_RUNS = (
    "SELECT CAST(date_trunc('week', flagged_at) AS TIMESTAMP) AS trained_at, count(*) AS n_samples, count(*) FILTER (WHERE rule_name = 'high_value') AS n_anomalies, "
    "strftime(date_trunc('week', flagged_at), '%Y%m%d') AS model_version FROM flags GROUP BY date_trunc('week', flagged_at) ORDER BY trained_at DESC LIMIT "
)
_BODY["recent_runs"] = _RUNS + "3"
_BODY["latest_run"] = _RUNS + "1"
_BODY["stream_window_metrics"] = _BODY["window_metrics"]
_BODY["stream_velocity"] = (
    "SELECT sender_id AS account_id, time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS window_start, count(*) AS txn_count "
    "FROM txn, range(5) r(i) WHERE sender_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"
)
_BODY["stream_dedupe"] = _BODY["dedupe_by"]
_BODY["stream_alert_keys"] = (
    "SELECT DISTINCT customer_id, rule_name, CAST(date_trunc(CASE window_type WHEN 'weekly' THEN 'week' WHEN 'monthly' THEN 'month' ELSE 'day' END, ts) AS TIMESTAMP) "
    "AS window_start FROM flags WHERE customer_id IS NOT NULL AND rule_name <> 'dormant_reactivation'"
)
_BODY["stream_enrich"] = (
    "SELECT t.txn_id, t.sender_id AS anchor_customer_id, c.name AS cust_name, c.segment AS cust_segment, c.customer_status AS cust_status "
    "FROM txn t LEFT JOIN cust c ON c.customer_id = t.sender_id"
)
_BODY["stream_pipeline"] = (
    f"SELECT {_FLAG_OUT}, {_d('alert_priority_score')} FROM (SELECT *, "
    "row_number() OVER (PARTITION BY rule_name ORDER BY alert_priority_score DESC NULLS LAST, ts DESC, txn_id) AS rn, "
    "least(12, 100 - 12 * (dense_rank() OVER (ORDER BY rule_name) - 1)) AS cap FROM flags) WHERE rn <= cap"
)
_BODY["upsert"] = (
    "WITH "
    + ", ".join(f"{n} AS ({_CTE[n]})" for n in ("ev", "wire", "txn"))
    + ", "
    + ", ".join(
        f"{name}_facts AS (SELECT DISTINCT sender_id AS s, receiver_id AS r, amount_eur AS a, ts FROM txn WHERE sender_id IS NOT NULL AND ts {cond}), "
        f"{name}_m AS ({_metric_select.replace(AS_OF, at) % _all_windows.replace('FROM facts', f'FROM {name}_facts')})"
        for name, cond, at in [
            ("old", "< TIMESTAMP '2024-01-20'", "TIMESTAMP '2024-01-20 00:00:00'"),
            ("new", ">= TIMESTAMP '2024-01-15'", AS_OF),
        ]
    )
    + f" SELECT {_METRIC_OUT} FROM (SELECT * FROM new_m UNION ALL SELECT * FROM old_m o WHERE NOT EXISTS (SELECT 1 FROM new_m n "
    "WHERE n.customer_id = o.customer_id AND n.window_type = o.window_type AND n.window_start = o.window_start))"
)

for _name, _rule in {
    "rule_weekly_volume": "weekly_volume",
    "rule_daily_velocity": "daily_velocity",
    "rule_monthly_peer": "monthly_peer_anomaly",
    "rule_geographic": "geographic",
    "rule_high_value": "high_value",
    "rule_smurfing": "smurfing",
    "rule_dormant": "dormant_reactivation",
    "rule_mule_inbound": "mule_inbound",
}.items():
    _BODY[_name] = f"SELECT {_FLAG_OUT} FROM hits WHERE customer_id IS NOT NULL AND rule_name = '{_rule}'"

for _name, _base, _metrics, _per in [
    ("evaluate_rules_asof", "batch", "asof_metrics", False),
    ("evaluate_rules_scoped", "scoped", "metrics", True),
]:
    _union = " UNION ALL ".join(f"({p})" for p in _rule_parts(_base, _metrics, _per))
    _BODY[_name] = f"SELECT {_FLAG_OUT} FROM ({_union}) WHERE customer_id IS NOT NULL"

_BODY.update(state_queries.bodies(AS_OF))
_BODY["keyed_table"] = _BODY["upsert"]
for _name, _same in {
    "archive_heavy": "archive", "party_join_heavy": "party_join", "history_laid": "history",
    "customer_txns_laid": "customer_txns_30d", "recent_sent_laid": "recent_sent",
}.items():
    _BODY[_name] = _BODY[_same]

ORACLE: dict[str, str] = {n: (b if n in ("upsert", "keyed_table") else _sql(b)) for n, b in _BODY.items()}
