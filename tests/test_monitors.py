"""Monitors on small hand-written tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import drill, monitor
from millrace.operators.monitor import Monitor
from millrace.operators.monitor_run import MonitorStore
from millrace.session import new_folder

NOW = datetime(2026, 1, 31)


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(1, 10.50, "succeeded"), (2, 25.00, "succeeded"), (3, 5.00, "failed")], "id int, total double, status string")


def history(spark, values, name="m", step=1):
    rows = [(name, "shop", "orders", v, NOW - timedelta(days=step * (len(values) - 1 - i))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, monitor.HISTORY_SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_eval_values_errors_and_empty_filters(spark, orders):
    monitors = [
        Monitor("paid", "raw_shop.orders", "SUM(total)", "status = 'succeeded'"),
        Monitor("none_count", "raw_shop.orders", "COUNT(*)", "status = 'absent'"),
        Monitor("none_sum", "raw_shop.orders", "SUM(total)", "status = 'absent'"),
        Monitor("all_rows", "raw_shop.orders", "COUNT(*)"),
        Monitor("bad_column", "raw_shop.orders", "SUM(nope)"),
        Monitor("bad_syntax", "raw_shop.orders", "SUM(("),
        Monitor("bad_filter", "raw_shop.orders", "COUNT(*)", "nope > 1"),
        Monitor("no_table", "raw_shop.gone", "COUNT(*)"),
    ]
    out = {r["metric_name"]: r for r in monitor.metric_eval(spark, {"raw_shop.orders": orders}, monitors, NOW).collect()}
    assert out["paid"]["metric_value"] == 35.5
    assert out["none_count"]["metric_value"] == 0.0
    assert out["none_sum"]["metric_value"] is None and out["none_sum"]["error"] is None
    assert out["all_rows"]["metric_value"] == 3.0
    assert all(out[n]["error"] for n in ("bad_column", "bad_syntax", "bad_filter", "no_table"))


def test_overlapping_filters_share_rows(spark, orders):
    monitors = [Monitor("big", "raw_shop.orders", "COUNT(*)", "total > 6"), Monitor("paid", "raw_shop.orders", "COUNT(*)", "status = 'succeeded'")]
    out = {r["metric_name"]: r["metric_value"] for r in monitor.metric_eval(spark, {"raw_shop.orders": orders}, monitors, NOW).collect()}
    assert out == {"big": 2.0, "paid": 2.0}


@pytest.mark.parametrize(
    "bad",
    [
        dict(name="1x", table="a.b", value="COUNT(*)"),
        dict(name="x", table="b", value="COUNT(*)"),
        dict(name="x", table="a.b", value="COUNT(*)", compare="yearly"),
        dict(name="x", table="a.b", value="COUNT(*)", alert_threshold=0),
    ],
)
def test_monitor_is_validated(bad):
    with pytest.raises(ValueError):
        Monitor(**bad)


def test_baselines(spark):
    rows = history(spark, [float(v) for v in range(1, 41)])
    facts = one(monitor.baselines(rows, NOW))
    assert facts["current_value"] == 40.0
    assert facts["week_over_week"] == 33.0
    assert facts["rolling_7day_avg"] == pytest.approx(sum(range(33, 41)) / 8)
    assert facts["rolling_30day_avg"] == pytest.approx(sum(range(10, 41)) / 31)
    assert one(monitor.baseline_prior(rows))["baseline_value"] == 39.0


def test_first_run_compares_with_itself(spark):
    rows = history(spark, [5.0])
    judged = monitor.settings(spark, [Monitor("m", "raw_shop.orders", "COUNT(*)", None, "week_over_week", 10.0)])
    out = one(monitor.monitor_compare(rows, judged, NOW))
    assert (out["baseline_value"], out["change_pct"], out["exceeds_threshold"], out["trend_slope"]) == (5.0, 0.0, False, None)


@pytest.mark.parametrize(("current", "base", "expected"), [(12.0, 10.0, 20.0), (-5.0, -10.0, 50.0), (1.0, 0.0, None), (1.0, None, None)])
def test_change_pct(spark, current, base, expected):
    df = spark.createDataFrame([(current, base)], "c double, b double")
    assert one(df.select(monitor.change_pct(F.col("c"), F.col("b")).alias("x")))["x"] == expected


def test_trend_needs_14_points_and_uses_the_newest_30(spark):
    assert one(monitor.trend(history(spark, [1.0] * 13)))["trend_slope"] is None
    rising = one(monitor.trend(history(spark, [1000.0] * 10 + [float(10 * i) for i in range(30)])))
    assert rising["trend_slope"] == pytest.approx(10.0)
    assert rising["trend_direction"] == "increasing"
    assert one(monitor.trend(history(spark, [3.0] * 20)))["trend_direction"] == "stable"


@pytest.mark.parametrize(
    ("last", "slope", "threshold", "mean", "expected"),
    [
        (100.0, 1.0, 20.0, 100.0, 20),
        (130.0, 1.0, 20.0, 100.0, 0),
        (100.0, 0.01, 20.0, 100.0, 365),
        (100.0, 50.0, 20.0, 100.0, None),
        (100.0, 0.0, 20.0, 100.0, None),
        (100.0, 1.0, None, 100.0, None),
        (0.0, 1.0, 20.0, 0.0, None),
    ],
)
def test_forecast(spark, last, slope, threshold, mean, expected):
    df = spark.createDataFrame([(last, slope, threshold, mean)], "l double, s double, t double, m double")
    got = one(df.select(monitor.forecast_days(F.col("l"), F.col("s"), F.col("t"), F.col("m")).alias("x")))["x"]
    assert got == expected


def test_summary_lines(spark):
    schema = "name string, change_pct double, exceeds_threshold boolean, trend_direction string"
    rows = spark.createDataFrame([("revenue", 25.34, True, None), ("visits", -3.0, False, "decreasing"), ("x", None, False, None)], schema)
    assert one(monitor.monitor_summary(rows))["summary"] == "1 flagged (revenue +25.3%), 1 trending. 3 total."
    assert one(monitor.monitor_summary(rows.limit(0)))["summary"] == "No issues. 0 total."


def test_latest_ignores_drill_rows(spark):
    rows = history(spark, [1.0, 2.0])
    schema = "metric_name string, result_type string, baseline_value double, change_pct double, exceeds_threshold boolean, trend_direction string, forecast_days int, computed_at timestamp_ntz"
    results = spark.createDataFrame(
        [
            ("m", "prior_period", 1.0, 100.0, True, None, None, NOW),
            ("m", "drill_down:currency", None, None, False, None, None, NOW + timedelta(seconds=1)),
        ],
        schema,
    )
    assert one(monitor.metric_latest(rows, results))["status"] == "flagged"


def test_contributors(spark):
    schema = "metric_name string, dimension string, group_value string, value double"

    def rows(*pairs):
        return spark.createDataFrame([("sales", "product", g, v) for g, v in pairs], schema)

    now = rows(("Widget", 100.0), ("Gadget", 50.0), (None, 7.0), ("New", 900.0), ("Zero", 5.0))
    old = rows(("Widget", 40.0), ("Gadget", 45.0), (None, 1.0), ("Gone", 30.0), ("Zero", 0.0))
    out = {r["group_value"]: r for r in drill.drill_contributors(now, old, top=10).collect()}
    assert out["Widget"]["rank"] == 1 and out["Widget"]["change_abs"] == 60.0 and out["Widget"]["change_pct"] == 150.0
    assert out["Gone"]["current_value"] == 0.0 and out["Gone"]["change_abs"] == -30.0
    assert out[None]["change_abs"] == 6.0
    assert out["New"]["change_abs"] is None and out["New"]["previous_value"] is None
    assert out["Zero"]["change_pct"] is None and out["Zero"]["change_abs"] == 5.0
    assert [r["group_value"] for r in drill.drill_contributors(now, old).orderBy("rank").collect()] == ["Widget", "Gone", None]
    assert drill.drill_contributors(now, old.limit(0)).count() == 0


def test_run_and_drill_only_flagged(spark, orders):
    monitors = [
        Monitor("revenue", "raw_shop.orders", "SUM(total)", None, "prior_period", 10.0, ("status",)),
        Monitor("rows", "raw_shop.orders", "COUNT(*)", None, "prior_period", 10.0, ("status",)),
        Monitor("broken", "raw_shop.orders", "SUM(nope)", None, "prior_period", 10.0),
    ]
    old = history(spark, [20.0], "revenue").union(history(spark, [3.0], "rows")).union(history(spark, [3.0], "broken"))
    tables = {"raw_shop.orders": orders}
    _, _, results = monitor.run_monitors(spark, tables, monitors, old, NOW + timedelta(days=1))
    assert [(r["name"], r["status"]) for r in results.collect()] == [("revenue", "flagged"), ("rows", "normal"), ("broken", "error")]
    snapshots = spark.createDataFrame([("revenue", "status", "failed", 1.0, NOW)], "metric_name string, dimension string, group_value string, value double, computed_at timestamp_ntz")
    current, contributors, errors = drill.drill_flagged(tables, monitors, results, snapshots)
    assert errors.count() == 0
    assert {r["metric_name"] for r in current.collect()} == {"revenue"}
    assert contributors.where("group_value = 'failed'").first()["change_abs"] == 4.0
    _, _, none = monitor.run_monitors(spark, tables, monitors, old, NOW, sources=["other"])
    assert none.count() == 0


def test_a_failing_monitor_leaves_the_others(spark, orders):
    monitors = [
        Monitor("zero", "raw_shop.orders", "SUM(total / (id - id))"),
        Monitor("share", "raw_shop.orders", "COUNT(CASE WHEN status = 'failed' THEN 1 END) / COUNT(*)", "id > 1"),
        Monitor("none", "raw_shop.orders", "COUNT(*) / COUNT(*)", "id > 100"),
        Monitor("own", "raw_shop.orders", "SUM(1 / (id - 2))", "id <> 2"),
        Monitor("rows", "raw_shop.orders", "COUNT(*)"),
    ]
    out = {r["metric_name"]: r for r in monitor.metric_eval(spark, {"raw_shop.orders": orders}, monitors, NOW).collect()}
    assert {n: r["metric_value"] for n, r in out.items() if r["error"] is None} == {"share": 0.5, "own": 0.0, "rows": 3.0}
    assert "DIVIDE_BY_ZERO" in out["zero"]["error"] and "DIVIDE_BY_ZERO" in out["none"]["error"]


def test_a_group_that_leaves_the_largest_ones_has_not_vanished(spark):
    rows = [("s", "d", f"g{i}", 1000.0 - i) for i in range(150)]
    old = spark.createDataFrame(rows, drill.BREAKDOWN)
    now = spark.createDataFrame([(*r[:3], 800.0 if r[2] == "g99" else r[3]) for r in rows], drill.BREAKDOWN)
    best = drill.drill_contributors(now, old).where("rank = 1").first()
    assert (best["group_value"], best["current_value"], best["change_abs"]) == ("g99", 800.0, -101.0)
    assert drill.largest_groups(now, 100).count() == 100 and drill.largest_groups(now, 100).where("group_value = 'g99'").count() == 0


def test_breakdown_keeps_all_groups(spark):
    df = spark.range(300).selectExpr("id", "cast(id as string) AS k")
    assert drill.drill_breakdown(df, Monitor("m", "raw_a.b", "SUM(id)", None, "none", None, ("k",))).count() == 300


def test_stored_runs_drill_and_isolate_a_failing_dimension(spark):
    store = MonitorStore(spark, new_folder(spark, "store"))
    watched = [Monitor("revenue", "raw_shop.orders", "SUM(total)", None, "prior_period", 10.0, ("status", "absent"))]
    for day, total in enumerate((10.0, 11.0, 50.0, 100.0)):
        rows = spark.createDataFrame([(total, "paid"), (1.0, "open")], "total double, status string")
        run = store.run({"raw_shop.orders": rows}, watched, NOW + timedelta(days=day))
    assert [r["metric_value"] for r in store.history().orderBy("recorded_at").collect()] == [11.0, 12.0, 51.0, 101.0]
    assert store.results().count() == 4 and store.snapshots().select("computed_at").distinct().count() == 2
    best = run.contributors.where("rank = 1").first()
    assert (best["group_value"], best["previous_value"], best["change_abs"]) == ("paid", 50.0, 50.0)
    assert [r["dimension"] for r in run.errors.collect()] == ["absent"]
