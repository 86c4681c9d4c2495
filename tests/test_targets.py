"""Target resolution against brute force, and over all search texts."""

import re

import pytest

from conftest import DATA
from tidewarden.operators import analytics, lookup
from tidewarden.plans import registry
from tidewarden.plans.workspace import Workspace

CUSTOMERS = [("CUST-0000003", "Anna Öz"), ("CUST-0000001", "Bob%_x"), ("CUST-0000002", None), ("X-77", "annA cust-y"), ("X-78", "y" * 90)]
TEXTS = [
    "cust", "CUST-", "0000003", "t-000000", "st-00%3", "%0000003", "a__-y", "____________", "_" * 90, "%_", "cust-y", "anna c", "000000", "öz", " ANNA", "77", "a", "%x", "B_b", "cu%77", "nothing", " ", "st-0000002", "y" * 80, "y" * 95,
    None, r"\%", "CUST-0000002", "%", "cust-0000002",
]


def _like(pattern: str, value: str | None) -> bool:
    parts = re.findall(r"\\.|.", pattern, re.S)
    wild = {"%": ".*", "_": "."}
    return re.search("".join(wild.get(p) or re.escape(p[-1]) for p in parts), value or "", re.I | re.S) is not None


def _indexed(queries, customers, flags):
    parts = lookup.build_parts(customers).cache()
    return lookup.resolve_targets(queries, customers, flags, lookup.Index(parts, lookup.build_postings(customers, parts)))


@pytest.mark.parametrize("shared", [None, 1000, 1, 0])
def test_texts_match_like_a_scan_of_all_customers(spark, monkeypatch, shared):
    """Without an index, with one, and with one all of whose grams are shared."""
    if shared is not None:
        monkeypatch.setattr(lookup, "SHARED", shared)
    resolve = analytics.resolve_targets if shared is None else _indexed
    customers = spark.createDataFrame(CUSTOMERS, "customer_id string, name string")
    flags = spark.createDataFrame([], "txn_id string, rule_name string, customer_id string, flagged_at timestamp")
    found = resolve(spark.createDataFrame([(t,) for t in TEXTS], "q string"), customers, flags)
    want = {}
    for q in TEXTS:
        sid = (q or "").strip(" ")
        hits = [i for i, name in CUSTOMERS if sid and (_like(sid, i) or _like(sid, name))]
        exact = [i for i, _ in CUSTOMERS if i == sid and sid.startswith("CUST-")]
        if hits:
            want[q] = min(exact or hits)
    assert {r["q"]: r["customer_id"] for r in found.collect()} == want


def test_all_ids_and_payments_are_asked(spark):
    w = Workspace(spark, DATA)
    df = registry.QUERIES["resolve_targets_all"](w)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    found = df.select("q", "mode").collect()
    assert {r["q"] for r in found} >= {r["customer_id"] for r in w.customers.select("customer_id").collect()}
    assert {r["q"] for r in found if r["mode"] == "alert"} >= {r["txn_id"] for r in w.flags.select("txn_id").distinct().collect()}
