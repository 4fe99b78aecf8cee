"""Profiles united from the sketches of a loader's units."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import profile, sketches
from millrace.operators.sketches import ProfileStore
from millrace.session import new_folder
from millrace.sources.file_load import FileLoader

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


@pytest.fixture
def landing(spark, tmp_path):
    folder, path = tmp_path / "in", new_folder(spark, "profiled")
    folder.mkdir()
    return folder, path, FileLoader(spark, "s", str(folder), path, SCHEMA), ProfileStore(spark, path)


def write(folder, name, ids):
    (folder / name).write_text("id,v,s\n" + "".join(f"{i},{i / 4},{'x' * (i % 7)}\n" for i in ids))


def rows(store):
    return {r["column_name"]: r for r in store.profile().collect()}


def test_only_the_units_of_a_load_are_read(spark, landing):
    folder, path, loader, store = landing
    write(folder, "a.csv", range(3000))
    write(folder, "b.csv", range(2000, 5000))
    store.update(loader, loader.sync(datetime(2024, 1, 1)))
    first = rows(store)
    assert first["id"]["row_count"] == 6000 and abs(first["id"]["distinct_count"] - 5000) <= 5000 * sketches.DISTINCT_ERROR
    # what is loaded already cannot be read any more, and is not
    for part in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/rows").select("path").collect():
        with open(part["path"].removeprefix("file:"), "wb") as file:
            file.write(b"no parquet")
    write(folder, "c.csv", range(9000, 9010))
    store.update(loader, loader.sync(datetime(2024, 1, 2)))
    assert rows(store)["id"]["row_count"] == 6010 and rows(store)["id"]["max_value"] == 9009


def test_a_changed_and_a_deleted_unit(spark, landing):
    folder, _, loader, store = landing
    for name in ("a.csv", "b.csv"):
        write(folder, name, range(100))
    store.update(loader, loader.sync(datetime(2024, 1, 1)))
    write(folder, "a.csv", range(50, 60))
    listing = loader.listing().withColumn("file_mtime", F.expr("file_mtime + INTERVAL 1 DAY")).where("file_path = 'a.csv'")
    store.update(loader, loader.sync(datetime(2024, 1, 2), listing))
    found = rows(store)
    assert (found["id"]["row_count"], found["id"]["min_value"], found["id"]["distinct_count"]) == (10, 50, 10)
    assert (found["s"]["null_count"], found["s"]["min_length"], found["s"]["max_length"]) == (1, 1, 6)
    assert found["v"]["mean_value"] == pytest.approx(54.5 / 4)
    live = profile.column_facts(loader.table().select("id", "v", "s"), SCHEMA.fields)
    for r in live.collect():
        assert (r["row_count"], r["null_count"], r["min_value"], r["max_value"]) == tuple(found[r["column_name"]][c] for c in ("row_count", "null_count", "min_value", "max_value"))


def test_quantiles_lie_within_their_rank_error(spark):
    df = spark.range(200_000).selectExpr("concat('u', id % 7) AS unit", "id % 50000 AS v", "CAST(NULL AS INT) AS none")
    found = {r["column_name"]: r for r in sketches.unite(sketches.unit_sketches(df, "unit")).collect()}
    assert abs(found["v"]["median"] / 50_000 - 0.5) <= sketches.RANK_ERROR and abs(found["v"]["p95"] / 50_000 - 0.95) <= sketches.RANK_ERROR
    assert abs(found["v"]["distinct_count"] - 50_000) <= 50_000 * sketches.DISTINCT_ERROR
    assert (found["none"]["null_count"], found["none"]["distinct_count"], found["none"]["median"]) == (200_000, 0, None)


def test_a_table_that_fails_at_run_time_fails_alone(spark):
    tables = {"good": spark.range(3), "bad": spark.range(3).selectExpr("1 / (id - id) AS ratio"), "odd": spark.createDataFrame([], "_load_id int")}
    out, errors = profile.profile_many(tables, "shop")
    assert {r["table_name"] for r in out.collect()} == {"good"}
    assert set(errors) == {"bad", "odd"} and "zero" in errors["bad"].lower()
