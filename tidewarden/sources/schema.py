"""Wire schema of a payment event."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING_HEAD = [
    "txn_id", "txn_category", "txn_type", "sender_id", "receiver_id",
    "sender_customer_no", "receiver_customer_no", "sender_name", "receiver_name",
    "sender_identity_no", "receiver_identity_no", "sender_branch", "receiver_branch",
    "sender_country", "receiver_country", "txn_description", "branch_id",
]

WIRE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in _STRING_HEAD]
    + [
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("amount_eur", T.DoubleType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("is_customer_sender", T.BooleanType()),
        T.StructField("is_customer_receiver", T.BooleanType()),
        T.StructField("ts", T.StringType()),
        T.StructField("is_synthetic_fraud", T.BooleanType()),
        T.StructField("fraud_type", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("merchant", T.StringType()),
    ]
)

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
