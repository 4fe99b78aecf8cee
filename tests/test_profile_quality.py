"""Profiles, tests and load checks on small hand-written tables."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile, quality

NOW = datetime(2026, 1, 31)


@pytest.fixture
def orders(spark):
    d = [datetime(2026, 1, i) for i in (1, 2, 3, 4)]
    rows = [
        (1, 10.50, "alice@example.com", True, d[0], "x"),
        (2, 25.00, "bob@example.com", True, d[1], "x"),
        (3, None, None, False, d[2], "x"),
        (4, 100.00, "alice@example.com", True, d[3], "x"),
        (5, 0.99, "carol@example.com", None, None, "x"),
    ]
    return spark.createDataFrame(rows, "id int, total double, email string, is_paid boolean, created_at timestamp_ntz, _load_id string")


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.mark.parametrize("approximate", [False, True])
def test_profile(spark, orders, approximate):
    out = by_column(profile.profile_table(orders, "shop", "orders", approximate))
    assert "_load_id" not in out
    total, email = out["total"], out["email"]
    assert (total["null_count"], total["null_pct"], total["distinct_count"], total["min_value"], total["max_value"]) == (1, 20.0, 4, 0.99, 100.0)
    assert total["mean_value"] == pytest.approx(136.49 / 4)
    assert (email["null_count"], email["distinct_count"], email["min_length"], email["max_length"]) == (1, 3, 15, 17)
    assert out["is_paid"]["distinct_count"] == 2 and out["created_at"]["distinct_count"] == 4


def test_profile_of_empty_table(spark, orders):
    out = by_column(profile.profile_table(orders.limit(0), "shop", "orders"))
    assert out["total"]["null_pct"] == 0.0 and out["total"]["distinct_count"] == 0 and out["total"]["min_value"] is None


def test_profile_of_all_types_and_long_text(spark):
    df = spark.sql(
        "SELECT id, CAST(id % 3 AS DECIMAL(10,2)) AS dec, array(id % 2) AS arr, repeat('a', 200 + CAST(id % 4 AS INT)) AS long, "
        "CASE WHEN id = 0 THEN -0.0D ELSE 0.0D END AS zero, CAST('2024-01-01' AS DATE) AS day, encode(CAST(id % 2 AS STRING), 'UTF-8') AS bin, named_struct('x', id % 5) AS st FROM range(20)"
    )
    out = {c: r["distinct_count"] for c, r in by_column(profile.profile_table(df, "s", "t")).items()}
    assert out == {"id": 20, "dec": 3, "arr": 2, "long": 4, "zero": 1, "day": 1, "bin": 2, "st": 5}


def test_nested_values_are_told_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (array('a, b'), named_struct('x', 'a, b', 'y', 'c')), (array('a', 'b'), named_struct('x', 'a', 'y', 'b, c')) AS t(arr, st)")
    assert {c: r["distinct_count"] for c, r in by_column(profile.profile_table(df, "s", "t")).items()} == {"arr": 2, "st": 2}
    assert {r["status"] for r in quality.dq_unique(df, "t", ["arr", "st"]).collect()} == {"pass"}


def test_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    assert by_column(profile.profile_table(df, "s", "t"))["v"]["distinct_count"] == 20_001


def test_stats_rows(spark, orders):
    samples = profile.profile_sample_values(orders)
    rows = profile.profile_stats(profile.profile_table(orders, "shop", "orders"), NOW, samples).collect()
    stats = {(r["column_name"], r["stat_type"]): r["stat_value"] for r in rows}
    assert stats["__row_count__", "row_count"] == "5"
    assert stats["total", "null_pct"] == "20.0" and stats["id", "max"] == "5"
    assert json.loads(stats["email", "sample_values"]) == ["alice@example.com", "bob@example.com", "carol@example.com"]


def test_sample_is_bounded_and_distinct(spark):
    df = spark.range(5000).select((F.col("id") % 50).cast("string").alias("v"), F.lit("").alias("blank"))
    out = by_column(profile.profile_sample_values(df))
    assert len(out["v"]["sample_values"]) == 5 == len(set(out["v"]["sample_values"])) and "blank" not in out


def test_profile_many_skips_and_isolates(spark, orders):
    tables = {"orders": orders, "_load_loads": orders, "spreadsheet": orders, "stg_shop__orders": orders, "stg_other__x": orders, "only_internal": orders.select("_load_id")}
    out, errors = profile.profile_many(tables, "shop")
    assert {r["table_name"] for r in out.select("table_name").distinct().collect()} == {"orders", "stg_shop__orders"}
    assert list(errors) == ["only_internal"]


def test_suggested_tests(spark, orders):
    out = {(r["column_name"], r["test"]) for r in quality.suggest_tests(profile.profile_table(orders, "shop", "orders"), ["email"]).collect()}
    assert out == {("id", "not_null"), ("id", "unique"), ("email", "not_null")}


def test_executed_tests(spark, orders):
    found = quality.dq_not_null(orders, "orders", ["id", "total"]).union(quality.dq_unique(orders, "orders", ["id", "email"]))
    found = found.union(quality.dq_accepted_values(orders, "orders", {"email": ["alice@example.com"]}))
    out = {(r["column_name"], r["test"]): (r["failures"], r["status"]) for r in found.collect()}
    assert out["total", "not_null"] == (1, "fail") and out["id", "not_null"] == (0, "pass")
    assert out["email", "unique"] == (1, "fail") and out["id", "unique"] == (0, "pass")
    assert out["email", "accepted_values"] == (2, "fail")
    assert quality.dq_unique(orders.limit(0), "orders", ["id"]).first()["status"] == "pass"
    report = quality.dq_report(found.withColumn("status", F.when(F.col("test") == "unique", F.lit("warn")).when(F.col("status") == "pass", F.lit("success")).otherwise("error"))).first()
    assert (report["passed"], report["warned"], report["failed"], report["tests"]) == (1, 2, 2, 5)


def test_cursor(spark, orders):
    ok = quality.cursor_validation(orders, "id").first()
    assert ok["valid"] and ok["sample_values"] == ["5", "4", "3", "2", "1"]
    assert quality.cursor_validation(orders, "created_at").first()["issues"] == ["1 NULL values found in cursor field"]
    assert "unexpected type" in quality.cursor_validation(orders, "total").first()["issues"][0]
    assert not quality.cursor_validation(orders, "gone").first()["column_exists"]
    assert quality.cursor_validation(orders.limit(0), "id").first()["sample_values"] == []


@pytest.mark.parametrize(("n", "score"), [(0, "empty"), (9, "very_low"), (10, "low"), (99, "low"), (100, "good"), (9999, "good"), (10000, "excellent")])
def test_completeness(spark, n, score):
    out = quality.completeness(spark.range(n), "t").first()
    assert (out["row_count"], out["health_score"], out["has_data"]) == (n, score, n > 0)


def test_mrr(spark):
    schema = "status string, plan__interval string, plan__amount bigint, quantity int, discount__coupon__duration string, discount__coupon__percent_off double, created timestamp_ntz"
    rows = [
        ("active", "month", 1000, 2, None, None, datetime(2026, 1, 1)),
        ("past_due", "year", 12000, 1, None, None, datetime(2026, 1, 31)),
        ("active", "month", 1000, 1, "forever", 50.0, datetime(2025, 1, 1)),
        ("active", "month", 1000, 1, "once", 50.0, datetime(2025, 1, 1)),
        ("canceled", "month", 9999, 1, None, None, datetime(2025, 1, 1)),
        ("active", "week", 9999, 1, None, None, datetime(2025, 1, 1)),
        ("active", "month", 9999, 1, None, None, datetime(2026, 2, 1)),
    ]
    assert quality.mrr(spark.createDataFrame(rows, schema), NOW).first()["mrr"] == 45.0
    assert quality.mrr(spark.createDataFrame([], schema), NOW).first()["mrr"] == 0.0


def test_churn(spark):
    events = spark.createDataFrame([("customer.subscription.deleted",), ("x",)], "type string")
    subs = spark.createDataFrame([("active",), ("past_due",), ("canceled",)], "status string")
    assert quality.churn_rate(events, subs).first()["churn_rate"] == 0.333
    assert quality.churn_rate(events.limit(0), subs.limit(0)).first()["churn_rate"] is None
