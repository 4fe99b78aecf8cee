"""Plans that must hold at size: pushed filters, pruned columns, bounded windows, no nested loops."""

from __future__ import annotations

import re

import pytest

from millrace import plans

FOLDER = "/root/testdata/sf0.001"
QUERIES = plans.QUERIES
plans.load_all()


def plan(spark, name):
    """The plan without any broadcast Spark would choose because the tables are small here."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    "name",
    [
        "run_monitors", "drill_contributors", "classify_files", "join_full_outer_compare", "drift_apply", "scd2_history",
        "scd2_timestamp", "write_delete_insert", "pii_overrides", "lineage_nodes", "freshness", "staleness", "gap_fill",
        "closed_sessions", "geo_enrich", "mart_rollup", "file_status", "distinct_visitors", "field_mapping_merge",
    ],
)
def test_no_nested_loops_and_no_forced_broadcast(spark, name):
    text = plan(spark, name)
    assert not re.search("NestedLoop|CartesianProduct|BroadcastHashJoin|EvalPython", text)


@pytest.mark.parametrize("name", ["date_range_filter", "incremental_cursor"])
def test_filters_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan(spark, name))


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(spark, "scan_pushdown")
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_returnflag:string>", plan(spark, "drill_breakdown"))


@pytest.mark.parametrize("name", ["dedup_last_modified", "dedup_first_seen", "trend", "join_inner_latest", "baseline_prior"])
def test_windows_are_bounded_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name))


def test_samples_are_not_broadcast_by_force(spark):
    assert "BroadcastHashJoin" not in plan(spark, "pii_scan") and "BroadcastHashJoin" not in plan(spark, "pii_full_scan")


def test_the_lag_filter_reaches_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan(spark, "incremental_lag"))


def test_monitors_with_one_filter_share_its_scan(spark):
    from millrace.operators import monitor
    from millrace.operators.monitor import Monitor

    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    paid = "o_orderstatus = 'F'"
    members = [Monitor("a", "raw_s.o", "SUM(o_totalprice)", paid), Monitor("b", "raw_s.o", "COUNT(*)", paid), Monitor("c", "raw_s.o", "COUNT(*)")]
    text = monitor._values(orders, members)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", text)) == 2 and "EqualTo(o_orderstatus,F)" in text


def test_newest_snapshot_is_found_without_sorting_snapshots(spark):
    assert "Window" not in plan(spark, "drill_snapshot")
