from decimal import Decimal

from pyspark.sql import functions as F

from conftest import at
from tidewarden.config import RULES, load_rules
from tidewarden.functions import text
from tidewarden.functions.calendar import relative_age, window_start
from tidewarden.functions.money import in_eur


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_window_starts(spark):
    ts = F.lit("2024-01-31 10:20:30").cast("timestamp")
    got = [str(one(spark, F.date_format(window_start(ts, w), "yyyy-MM-dd"))) for w in ("daily", "weekly", "biweekly", "monthly")]
    assert got == ["2024-01-31", "2024-01-29", "2024-01-18", "2024-01-01"]
    after = F.lit("2026-01-15 00:00:00").cast("timestamp")
    assert one(spark, F.date_format(window_start(after, "biweekly"), "yyyy-MM-dd")) == "2026-01-15"


def test_relative_age(spark):
    df = spark.createDataFrame(
        [(at("2024-01-02 00:00:00"),), (at("2024-01-01 23:00:01"),), (at("2024-01-01 00:00:01"),), (at("2023-12-30 00:00:00"),), (at("2024-01-03 00:00:00"),), (None,)],
        "ts timestamp",
    )
    got = [r[0] for r in df.select(relative_age(F.col("ts"), "2024-01-02 00:00:00")).collect()]
    assert got == ["0m ago", "59m ago", "23h ago", "3d ago", "0m ago", "—"]


def test_mask_and_hash(spark):
    df = spark.createDataFrame([(None,), ("",), ("1234",), ("12345",)], "v string")
    assert [r[0] for r in df.select(text.mask_identity(F.col("v"))).collect()] == ["—", "****", "****", "123****45"]
    hashed = [r[0] for r in df.select(text.hash_id(F.col("v"))).collect()]
    assert hashed[:2] == ["—", "—"] and len(hashed[2]) == 16


def test_human_bytes(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1023.0,), (1536.0,), (1024.0**5,), (3 * 1024.0**6,)], "v double")
    got = [r[0] for r in df.select(text.human_bytes(F.col("v"))).collect()]
    assert got == ["—", "0 B", "1023 B", "1.5 KB", "1.0 PB", "3072.0 PB"]


def test_fx_is_exact_and_defaults_to_one(spark):
    df = spark.createDataFrame([(Decimal("100.00"), "TRY"), (Decimal("100.00"), "XXX"), (Decimal("100.00"), None)], "a decimal(18,2), c string")
    got = [r[0] for r in df.select(in_eur(F.col("a"), F.col("c"))).collect()]
    assert got == [Decimal("2.70000"), Decimal("100.00000"), Decimal("100.00000")]


def test_rules_file_merges_sections(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"high_value": {"threshold_eur": 5}, "smurfing": {"weekly_small_txn_count": 3}}')
    merged = load_rules(str(path))
    assert merged["high_value"] == {"threshold_eur": 5}
    assert merged["smurfing"] == {"weekly_small_txn_threshold_eur": 500, "weekly_small_txn_count": 3}
    assert merged["geographic"] == RULES["geographic"]
    assert load_rules(str(tmp_path / "absent.json")) == RULES
