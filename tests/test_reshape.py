"""Reshaping functions on the record forms sources send."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import casts, names, records, times
from millrace.functions.records import FieldLabels


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("serial", "expected"),
    [(45292, datetime(2024, 1, 1)), (45292.5, datetime(2024, 1, 1, 12)), (0, datetime(1899, 12, 30)), (45292.99999, datetime(2024, 1, 1, 23, 59, 59))],
)
def test_serial(spark, serial, expected):
    assert value(spark, times.serial_to_timestamp(F.lit(serial))) == expected
    assert value(spark, times.serial_to_date(F.lit(serial))) == expected.date()


@pytest.mark.parametrize(
    ("dimension", "text", "expected"),
    [
        ("date", "20240131", datetime(2024, 1, 31)),
        ("dateHour", "2024013113", datetime(2024, 1, 31, 13)),
        ("dateHourMinute", "202401311359", datetime(2024, 1, 31, 13, 59)),
        ("yearMonth", "202401", datetime(2024, 1, 1)),
        ("year", "2024", datetime(2024, 1, 1)),
        ("isoYearIsoWeek", "202401", datetime(2024, 1, 1)),
        ("isoYearIsoWeek", "202053", datetime(2020, 12, 28)),
        ("isoYearIsoWeek", "202101", datetime(2021, 1, 4)),
        ("isoYearIsoWeek", "(other)", None),
        ("date", "(not set)", None),
        ("country", "de", "de"),
    ],
)
def test_report_dimensions(spark, dimension, text, expected):
    assert value(spark, times.report_dimension_parse(dimension, F.lit(text))) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000.5", datetime(2023, 11, 14, 22, 13, 20, 500000)),
        ("0", None),
        ("soon", None),
    ],
)
def test_epoch(spark, raw, expected):
    assert value(spark, times.epoch_normalize(F.lit(raw))) == expected


@pytest.mark.parametrize("raw", ["1700000000000", "2023-11-14T22:13:20Z", "2023-11-15T00:13:20+02:00"])
def test_iso_text(spark, raw):
    assert value(spark, times.datetime_iso_normalize(F.lit(raw))) == "2023-11-14T22:13:20.000000Z"


@pytest.mark.parametrize(("text", "whole", "number"), [("12", 12, 12.0), (" -3 ", -3, -3.0), ("1.5", None, 1.5), ("1e3", None, 1000.0), ("99999999999999999999", None, 1e20), ("x", None, None), ("", None, None)])
def test_casts(spark, text, whole, number):
    assert value(spark, casts.to_long(F.lit(text))) == whole
    assert value(spark, casts.to_double(F.lit(text))) == number


def test_names():
    assert names.normalize_name("Total--Price (EUR)") == "total_price_eur"
    assert names.is_internal("_SRC_file") and not names.is_internal("src")


def test_sheet(spark):
    df = spark.createDataFrame([(1, ["a", "", "c"]), (2, []), (3, ["x"])], "row int, cells array<string>")
    out = records.sheet_rows_clean(df, "cells", ["first", "second", ""], ["row"])
    assert [tuple(r) for r in out.orderBy("row").collect()] == [(1, "a", None), (3, "x", None)]


def test_ranges(spark):
    ranges = spark.createDataFrame([("none",), ("head",), ("blank",), ("good",)], "range_name string")
    rows = spark.createDataFrame([("head", 0, ["h"]), ("blank", 0, []), ("blank", 1, ["x"]), ("good", 0, ["h"]), ("good", 1, [])], "range_name string, row_no int, values array<string>")
    out = {r["range_name"]: r["reason"] for r in records.range_status(ranges, rows).collect()}
    assert out == {"none": "empty", "head": "header_only", "blank": "blank_first_row", "good": None}


def test_flatten(spark):
    schema = "segments struct<date: string>, metrics struct<cost_micros: string, clicks: string, ctr: string>, campaign struct<id: bigint, name: string>"
    out = records.flatten_struct(spark.createDataFrame([(("2024-01-02",), ("1500000", "7", "0.5"), (3, "c")), (("2024-01-03",), (None, None, "bad"), (4, None))], schema))
    assert [tuple(r) for r in out.collect()] == [(date(2024, 1, 2), 1.5, 7, 0.5, 3, "c"), (date(2024, 1, 3), 0.0, None, None, 4, None)]
    assert out.columns == ["date", "cost", "clicks", "ctr", "campaign_id", "campaign_name"]


def test_labels(spark):
    fields = [FieldLabels("h1", "kind", "enum", {"1": "one"}), FieldLabels("h2", "tags", "set", {"1": "one"}), FieldLabels("h3", "plain", "text")]
    df = spark.createDataFrame([(1, 1, [1, 9], "x"), (2, 9, None, None)], "id int, h1 int, h2 array<int>, h3 string")
    assert [tuple(r) for r in records.enum_relabel(df, fields).collect()] == [(1, "one", ["one", "9"], "x"), (2, "9", None, None)]


def test_custom_fields(spark):
    fields = [FieldLabels("1", "Size", "enum", {"s": "Small"}), FieldLabels("2", "Tags", "set", {"a": "Alpha"}), FieldLabels("3", "Note", "text")]
    df = spark.createDataFrame([(7, [(1, "s"), (2, '["a", "z"]'), (3, "n"), (9, "?")]), (8, [(1, "xl")])], "id bigint, custom_fields array<struct<id: bigint, value: string>>")
    out = [tuple(r) for r in records.custom_field_pivot(df, fields).collect()]
    assert out[0][:4] == (7, "Small", ["Alpha", "z"], "n") and [tuple(x) for x in out[0][4]] == [(9, "?")]
    assert out[1] == (8, None, None, None, [])


def test_field_mapping_keeps_the_first(spark):
    schema = "key string, name string, option_id string, label string"
    known = spark.createDataFrame([("k", "First", "1", "old")], schema)
    fresh = spark.createDataFrame([("k", "Second", "1", "new"), ("k", "Second", "2", "two"), ("n", "New", "1", "x")], schema)
    assert sorted(tuple(r) for r in records.field_mapping_merge(known, fresh).collect()) == [("k", "First", "1", "old"), ("k", "First", "2", "two"), ("n", "New", "1", "x")]


def test_stages(spark):
    d = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", d, None), (None, d, d), ("b", None, None)], "id string, hs_v2_date_entered_1 timestamp_ntz, hs_v2_date_entered_closed timestamp_ntz")
    assert [tuple(r) for r in records.stage_unpivot(df).collect()] == [("a", d, "1")]


def test_report_by_date(spark):
    text = '{"2024-01-01": [{"label": "a", "n": 1}, {"label": "b"}], "2024-01-02": {"label": "c", "n": 3}, "2024-01-03": []}'
    df = spark.createDataFrame([(1, text), (2, "broken"), (3, None)], "site int, report string")
    out = records.report_explode_by_date(df, "report", "label: string, n: bigint", ["site"])
    d = date
    assert sorted(tuple(r) for r in out.collect()) == [(1, d(2024, 1, 1), "a", 1), (1, d(2024, 1, 1), "b", None), (1, d(2024, 1, 2), "c", 3)]


def test_attributes(spark):
    df = spark.createDataFrame([("r", "i", [("d", "date", "2024-01-02"), ("e", "date", ""), ("s", "string", "x")])], "report_id string, item_id string, attributes array<struct<attribute_id: string, data_type: string, value: string>>")
    out = records.attribute_pivot(df, {"d": "date", "e": "date", "s": "string", "gone": "string"}).first()
    assert tuple(out) == ("r", "i", date(2024, 1, 2), None, "x", None)


def test_child_tables_to_a_depth(spark):
    df = spark.createDataFrame([(1, [([("x",)], "a"), ([], "b")])], "id int, items array<struct<parts: array<struct<p: string>>, name: string>>")
    out = records.split_nested(df, "Order", ["id"])
    assert set(out) == {"Order", "order__items", "order__items__parts"}
    assert [tuple(r) for r in out["order__items"].collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert [tuple(r) for r in out["order__items__parts"].collect()] == [(1, 0, 0, "x")]
    cut = records.split_nested(df, "Order", ["id"], max_depth=1)
    assert set(cut) == {"Order", "order__items"}
    assert [tuple(r) for r in cut["order__items"].collect()] == [(1, 0, '[{"p":"x"}]', "a"), (1, 1, "[]", "b")]


def test_lists_at_any_depth_become_tables(spark):
    deep = spark.createDataFrame([(1, [([([([("z",)],)],)],)])], "id int, a array<struct<b: array<struct<c: array<struct<d: array<struct<e: string>>>>>>>>")
    out = records.split_nested(deep, "t", ["id"])
    assert [tuple(r)[-1] for r in out["t__a__b__c__d"].collect()] == ["z"]


def test_extended_json(spark):
    cases = {
        '{"$oid": "5f"}': "5f",
        '{"$numberDecimal": "1.50"}': "1.50",
        '{"$date": "2024-01-01T00:00:00Z"}': "2024-01-01T00:00:00.000Z",
        '{"$date": {"$numberLong": "1704067200000"}}': None,
        '{"$timestamp": {"t": 1704067200, "i": 1}}': "2024-01-01T00:00:00Z",
        '{"$regularExpression": {"pattern": "^a", "options": "i"}}': "^a",
        '{"plain": 1}': '{"plain": 1}',
        "text": "text",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    out = {r["c"]: r["v"] for r in df.select("c", records.bson_normalize(F.col("c")).alias("v")).collect()}
    assert {k: v for k, v in out.items() if cases[k] is not None} == {k: v for k, v in cases.items() if v is not None}


def test_sentinels_and_cursor(spark):
    out = records.sentinel_keys(spark.createDataFrame([(None, "2")], "campaign_id string, ad_id string")).first().asDict()
    assert out == {"campaign_id": "no_campaign_id", "ad_id": "2", "adset_id": "no_adset_id", "date_start": "no_date_start"}
    assert value(spark, records.parse_cursor_json(F.lit('{"meta": {"next": ""}}'), "$.meta.next")) is None
    assert value(spark, records.parse_cursor_json(F.lit('{"meta": {"next": "abc"}}'), "$.meta.next")) == "abc"


def test_message_ids_differ(spark):
    cases = [("t", 1, None, 1), ("t", 1, None, 2), ("t", 11, "", 1), ("t1", 1, "", 1), ("t", 1, "k", 1), ("t\x1f1", 1, "k", 1), ("t", 1, "1\x1fk", 1), ("t", 1, "1:k", 1), ("t1:1", 1, "k", 1)]
    df = spark.createDataFrame(cases, "t string, p int, k string, o int")
    assert df.select(records.message_id(*[F.col(c) for c in "tpko"]).alias("i")).distinct().count() == len(cases)
