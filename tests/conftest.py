import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewarden.operators.normalize import TXN_COLUMNS  # noqa: E402
from tidewarden.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
UTC = dt.timezone.utc

_TYPES = {"amount": "decimal(18,2)", "amount_eur": "decimal(18,2)", "ts": "timestamp", "ingested_at": "timestamp"}
_TYPES.update({c: "boolean" for c in ("is_customer_sender", "is_customer_receiver", "is_synthetic_fraud")})
TXN_DDL = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in TXN_COLUMNS)
CUSTOMER_DDL = "customer_id string, name string, risk_score decimal(5,2), customer_status string, segment string, is_pep boolean"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        4,
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def txn(txn_id, sender, eur, when, receiver="EXT-1", **more):
    row = dict.fromkeys(TXN_COLUMNS)
    row.update(
        txn_id=str(txn_id), sender_id=sender, sender_customer_no=sender, receiver_id=receiver,
        receiver_customer_no=receiver, amount=Decimal(str(eur)), amount_eur=Decimal(str(eur)), currency="EUR",
        txn_type="FAST", txn_category="Wire", sender_country="DE", receiver_country="DE", country_code="DE",
        is_customer_sender=True, is_customer_receiver=False, is_synthetic_fraud=True, ts=at(when), ingested_at=at(when),
        sender_name="S", receiver_name="R", sender_identity_no="1", receiver_identity_no="2",
    )
    row.update(more)
    return tuple(row[c] for c in TXN_COLUMNS)


@pytest.fixture
def make_txns(spark):
    return lambda rows: spark.createDataFrame(rows, TXN_DDL)


@pytest.fixture
def make_customers(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "retail", False)[:6] for r in rows], CUSTOMER_DDL)

    return build


def rows(df):
    return sorted(tuple(r) for r in df.collect())
