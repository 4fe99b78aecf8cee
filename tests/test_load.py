"""Dispositions, guards, incremental reads, files and stores on small data."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import dedup, load, staging
from millrace.session import materialize, new_folder, work_folder
from millrace.sources import file_load, files
from millrace.sources.file_load import FileLoader, SchemaMismatchError
from millrace.sources.store import ConflictError, EmptyReplaceError, KeyedTable, VersionedTable, merge_partitions

T1, T2, T3 = (datetime(2026, 1, i) for i in (1, 2, 3))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, *data):
    return spark.createDataFrame(list(data), "id int, v string, at timestamp_ntz")


def test_merge_is_idempotent_and_null_safe(spark):
    target = table(spark, (1, "a", T1), (2, "b", T1), (None, "n", T1))
    batch = table(spark, (2, "old", T1), (2, "new", T2), (3, "c", T1), (None, "m", T2))
    once = load.write_merge(target, batch, ["id"], ["at"])
    expected = {(1, "a"), (2, "new"), (3, "c"), (None, "m")}
    assert {(r["id"], r["v"]) for r in once.collect()} == expected
    assert {(r["id"], r["v"]) for r in load.write_merge(once, batch, ["id"], ["at"]).collect()} == expected


def test_merge_of_a_hot_key(spark):
    batch = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("id"), F.col("id").cast("string").alias("v"), F.lit(T1).alias("at"))
    out = load.write_merge(table(spark, (0, "x", T1)), batch, ["id"], ["at"])
    assert out.count() == out.select("id").distinct().count() == 20_001


def test_delete_insert_keeps_all_rows_of_the_batch(spark):
    target = table(spark, (1, "a", T1), (1, "b", T1), (2, "c", T1))
    batch = table(spark, (1, "x", T2), (1, "y", T2))
    assert {(r["id"], r["v"]) for r in load.write_delete_insert(target, batch, ["id"]).collect()} == {(1, "x"), (1, "y"), (2, "c")}


def test_versioned_table(spark):
    store = VersionedTable(spark, new_folder(spark, "t"))
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.read()
    store.replace(table(spark, (1, "a", T1)))
    store.append(table(spark, (2, "b", T1)))
    store.merge(table(spark, (2, "c", T2), (3, "d", T2)), ["id"], ["at"])
    store.delete_insert(table(spark, (1, "z", T3)), ["id"])
    store.append(table(spark, (4, "e", T3)))
    store.delete_insert(table(spark, (4, "f", T3)), ["id"])
    store.compact()
    store.replace(store.read().where("id < 4"))
    assert {(r["id"], r["v"]) for r in store.read().collect()} == {(1, "z"), (2, "c"), (3, "d")}
    with pytest.raises(EmptyReplaceError):
        store.replace(table(spark, (1, "a", T1)).limit(0))
    assert store.read().count() == 3
    store.replace(table(spark, (1, "a", T1)).limit(0), allow_empty=True)
    assert store.read().count() == 0


def test_appends_merge_their_columns(spark):
    store = VersionedTable(spark, new_folder(spark, "narrow"))
    store.append(spark.createDataFrame([(1, "a")], "id int, v string"))
    store.append(spark.createDataFrame([(2,)], "id int"))
    store.append(spark.createDataFrame([(3, 1.5)], "id int, w double"))
    assert store.read().columns == ["id", "v", "w"]
    assert {tuple(r) for r in store.read().collect()} == {(1, "a", None), (2, None, None), (3, None, 1.5)}
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "id string"))
    assert store.read().count() == 3


def interrupted(store, between):
    """A table whose next write is interrupted by what ``between`` does with the same table."""
    write = store._write

    def late(df):
        folder = write(df)
        store._write = write
        between()
        return folder

    store._write = late
    return store


def test_an_append_during_an_append_is_kept(spark):
    path = new_folder(spark, "writers")
    store, other = VersionedTable(spark, path), VersionedTable(spark, path)
    store.append(table(spark, (1, "a", T1)))
    interrupted(store, lambda: other.append(table(spark, (2, "b", T1)))).append(table(spark, (3, "c", T1)))
    assert {r["id"] for r in store.read().collect()} == {1, 2, 3}


def test_a_write_from_an_old_version_is_refused(spark):
    path = new_folder(spark, "writers")
    store, other = VersionedTable(spark, path), VersionedTable(spark, path)
    store.append(table(spark, (1, "a", T1)))
    more = table(spark, (2, "b", T1))
    for write in (lambda: store.merge(more, ["id"]), lambda: store.replace(more), store.compact):
        interrupted(store, lambda: other.append(more))
        with pytest.raises(ConflictError):
            write()
    assert [r["id"] for r in store.read().orderBy("id").collect()] == [1, 2, 2, 2]


def test_of_two_writers_from_one_version_one_is_told_that_it_lost(spark):
    path = new_folder(spark, "race")
    store, other = VersionedTable(spark, path), VersionedTable(spark, path)
    store.append(table(spark, (1, "a", T1)))
    base = store._newest()
    folders = [store._write(table(spark, (i, "x", T1))) for i in (2, 3)]
    # both have looked before either publishes, and the first is asked again after the second
    assert store._commit("append", folders[0], base.schema, base)
    assert not other._commit("append", folders[1], base.schema, base)
    assert {r["id"] for r in VersionedTable(spark, path).read().collect()} == {1, 2}
    with pytest.raises(ConflictError):
        other._commit_whole("replace", folders[1], base.schema, base)


def test_no_append_of_many_writers_is_lost(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = new_folder(spark, "crowd")
    frames = [table(spark, (k, "x", T1)) for k in range(12)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda df: VersionedTable(spark, path).append(df), frames))
    assert sorted(r["id"] for r in VersionedTable(spark, path).read().collect()) == list(range(12))


def files_of(spark, store):
    version = store.log.newest()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{f}/_part={p}" for p, f in version.parts.items()])
    return {r["path"] for r in rows.select("path").collect()}


def test_keyed_table_leaves_other_buckets_alone(spark):
    store = KeyedTable(spark, new_folder(spark, "keyed"), ["id"], buckets=8)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.merge(spark.range(200).selectExpr("id", "'old' AS v"))
    before, parts = files_of(spark, store), dict(store.log.newest().parts)
    store.merge(spark.createDataFrame([(3, "new"), (3, "newest"), (1000, "new")], "id bigint, v string"), ["v"], {"batch": 1})
    touched = {p for p, f in store.log.newest().parts.items() if parts.get(p) != f}
    assert 1 <= len(touched) <= 2 and store.note() == {"batch": 1}
    kept = {f for f in before if f.split("_part=")[1].split("/")[0] not in touched}
    assert kept and kept <= files_of(spark, store)
    rows = {r["id"]: r["v"] for r in store.read().collect()}
    assert len(rows) == 201 and rows[3] == "newest" and rows[1000] == "new" and rows[4] == "old"


def test_keyed_table_shuffles_only_the_batch(spark):
    store = KeyedTable(spark, new_folder(spark, "plan"), ["id"], buckets=4)
    store.merge(spark.range(100).selectExpr("id", "'old' AS v"))
    fresh = materialize(spark.createDataFrame([(3, "new")], "id bigint, v string"), "batch")
    base = store.log.newest()
    plan = store.kept(base, fresh, list(base.parts))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_keyed_table_delete_insert_nulls_and_new_columns(spark):
    store = KeyedTable(spark, new_folder(spark, "keyed"), ["id"], buckets=4)
    store.delete_insert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "id int, v string"))
    store.delete_insert(spark.createDataFrame([(1, "x", 1.5), (None, "y", 2.5)], "id int, v string, w double"))
    assert sorted(map(str, map(tuple, store.read().collect()))) == sorted(map(str, [(1, "x", 1.5), (2, "c", None), (None, "y", 2.5)]))
    store.merge(store.read().limit(0))
    assert store.read().count() == 3


def test_keyed_table_refuses_a_merge_from_an_old_version(spark):
    path = new_folder(spark, "keyed")
    store, other = (KeyedTable(spark, path, ["id"], buckets=4) for _ in range(2))
    store.merge(spark.range(10).selectExpr("id", "'a' AS v"))
    base = store.log.newest()
    other.merge(spark.range(3).selectExpr("id", "'b' AS v"))
    store.log.newest = lambda: base
    with pytest.raises(ConflictError):
        store.merge(spark.range(5).selectExpr("id", "'c' AS v"))
    assert other.read().where("v = 'b'").count() == 3


def test_a_partition_value_is_a_part(spark):
    store = KeyedTable(spark, new_folder(spark, "days"), ["id"], partition="day")
    store.merge(spark.createDataFrame([(1, "2024/01 ?"), (2, None), (3, "")], "id int, day string"))
    store.merge(spark.createDataFrame([(3, ""), (4, "x")], "id int, day string"))
    assert len(store.log.newest().parts) == 4
    assert {tuple(r) for r in store.read().collect()} == {(1, "2024/01 ?"), (2, None), (3, ""), (4, "x")}


def test_csv_cells_and_names(spark, tmp_path):
    (tmp_path / "r[1].csv").write_text('id,"long\nname",v\n1,"two\nlines",3\n2,"say ""x"", y",4\n')
    (tmp_path / "s.csv").write_text('v,id,"long\nname"\n5,3,plain\n')
    schema = T.StructType.fromDDL("id int, `long\nname` string, v int")
    out = files.scan_files(spark, str(tmp_path), schema, provenance=True)
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, "two\nlines", 3, "r[1].csv"), (2, 'say "x", y', 4, "r[1].csv"), (3, "plain", 5, "s.csv")]
    only = files.scan_files(spark, str(tmp_path), schema, wanted=["r[1].csv"])
    assert only.count() == 2


def test_a_cell_that_does_not_fit_fails_the_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id,v\n1,2\nxx,3\n")
    loader = FileLoader(spark, "s", str(tmp_path / "in"), str(tmp_path / "out"), T.StructType.fromDDL("id int, v int"))
    with pytest.raises((PySparkException, Py4JError)):
        loader.sync(T1)
    assert loader.ledger().count() == 0


def test_all_mismatched_files_are_told(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02}.csv").write_text("id,other\n1,2\n")
    loader = FileLoader(spark, "s", str(tmp_path), str(tmp_path / "out"), T.StructType.fromDDL("id int, v int"))
    with pytest.raises(SchemaMismatchError) as error:
        loader.sync(T1)
    assert all(f"f{i:02}.csv" in str(error.value) for i in range(30))


def test_merge_partitions_leaves_others_alone(spark):
    path = new_folder(spark, "p")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id int, v string, p string")
    df.write.partitionBy("p").parquet(path)
    before = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect() if "p=y" in r["path"]}
    merge_partitions(spark, path, spark.createDataFrame([(2, "B", "x"), (4, "d", "x")], df.schema), ["id"], "p")
    out = spark.read.schema(df.schema).parquet(path)
    assert {tuple(r) for r in out.collect()} == {(1, "a", "x"), (2, "B", "x"), (4, "d", "x"), (3, "c", "y")}
    after = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect() if "p=y" in r["path"]}
    assert before == after


@pytest.mark.parametrize(("total", "level"), [(0, "error"), (49, "warning"), (50, "none"), (300, "none"), (301, "warning")])
def test_row_count_anomaly(spark, total, level):
    schema = "source string, timestamp timestamp_ntz, status string, rows_processed bigint, total_row_count bigint"
    history = spark.createDataFrame([("s", T1, "success", 5, 100), ("s", T2, "success", 0, 0), ("s", T3, "failed", 9, 900)], schema)
    totals = spark.createDataFrame([("s", total), ("new", 1)], "source string, total_rows bigint")
    assert [(r["source"], r["level"]) for r in load.row_count_anomaly(totals, history).collect()] == [("s", level)]


def test_row_count_anomaly_looks_back_five_runs(spark):
    schema = "source string, timestamp timestamp_ntz, status string, rows_processed bigint, total_row_count bigint"
    history = spark.createDataFrame([("s", datetime(2026, 1, i), "success" if i == 1 else "failed", 5, 100) for i in range(1, 7)], schema)
    assert load.row_count_anomaly(spark.createDataFrame([("s", 0)], "source string, total_rows bigint"), history).count() == 0


def test_durations():
    assert [load.duration_days(t) for t in ("7d", "2w", "1m", "3M")] == [7, 14, 30, 90]
    for bad in ("0d", "d", "7", "7y", "-1d"):
        with pytest.raises(ValueError):
            load.duration_days(bad)


def test_backfill_conflicts(spark):
    with pytest.raises(ValueError):
        load.backfill_window(table(spark, (1, "a", T1)), "at", "7d", T3, since=date(2026, 1, 1))


def test_cursor_directions(spark):
    df = table(spark, (1, "a", T1), (2, "b", T2), (3, "c", T3))
    kept, state = load.incremental_cursor(df, "id", 2)
    assert rows(kept.select("id")) == [(2,), (3,)] and state.first()["last_value"] == 3
    kept, state = load.incremental_cursor(df, "id", 2, direction="min")
    assert rows(kept.select("id")) == [(1,), (2,)] and state.first()["last_value"] == 1
    assert load.incremental_cursor(df.limit(0), "id", 2)[1].first()["last_value"] == 2


def test_lag_on_an_empty_target_takes_all(spark):
    df = table(spark, (1, "a", T1), (2, "b", T2))
    assert load.incremental_lag(df.limit(0), df, ["id"], "at", 1).count() == 2


def test_clamp_start(spark):
    df = spark.createDataFrame([(T3,), (datetime(2000, 1, 1),), (None,)], "c timestamp_ntz")
    out = [r["s"] for r in df.select(load.clamp_start(F.col("c"), 2, T3).alias("s")).collect()]
    assert out == [date(2026, 1, 1), date(2022, 12, 3), date(2022, 12, 3)]


def test_infer_dedup():
    assert dedup.infer_dedup(["paid", "order_id", "Updated_At"]) == ("order_id", "Updated_At")
    assert dedup.infer_dedup(["paid", "updated_at"]) is None
    assert dedup.infer_dedup(["id", "name"]) is None


def test_scd2_is_idempotent_with_one_open_version(spark):
    keys = ["id"]
    loads = [table(spark, (1, "a", T1), (2, "b", T1)), table(spark, (1, "A", T2), (2, "b", T1), (3, "c", T2)), table(spark, (1, "A", T2))]
    snapshot = None
    for one in loads + loads[-1:]:
        snapshot = staging.scd2_timestamp(snapshot, one, keys, "at")
    out = {(r["id"], r["v"], r["valid_from"], r["valid_to"]) for r in snapshot.collect()}
    assert out == {(1, "a", T1, T2), (1, "A", T2, None), (2, "b", T1, None), (3, "c", T2, None)}
    # An older row does not close a newer version.
    late = staging.scd2_timestamp(snapshot, table(spark, (1, "late", T1)), keys, "at")
    assert late.count() == 4


def test_scd2_check_sees_nulls(spark):
    one = staging.scd2_check(None, table(spark, (1, "a", T1)), ["id"], T1)
    two = staging.scd2_check(one, table(spark, (1, None, T1)), ["id"], T2)
    assert {(r["v"], r["valid_to"]) for r in two.collect()} == {("a", T2), (None, None)}
    assert staging.scd2_check(two, table(spark, (1, None, T1)), ["id"], T3).count() == 2


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH x AS (SELECT 1 AS a) SELECT * FROM x ORDER BY a LIMIT 1", "SELECT count(*) FROM t HAVING count(*) > 0", "SELECT DISTINCT id FROM t;",
    "SELECT /*+ REPARTITION(2) */ id FROM t", "SELECT id FROM t WHERE id IN (SELECT max(id) FROM T)", "SELECT id, (SELECT count(*) FROM t) AS n FROM t -- all",
    "SELECT a.id FROM t a JOIN (SELECT id FROM t) b ON a.id = b.id", "SELECT explode(array(1, 2)) AS x"])
def test_query_select_accepts(spark, sql):
    out, more = staging.query_select(spark, sql, {"t": spark.range(3)}, max_rows=100)
    out.collect()
    assert more.first()["truncated"] is False


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1", "SHOW TABLES", "SELECT 1 UNION SELECT 2", "", "VALUES (1)",
    "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' AS x FROM t)", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')",
    "SELECT id FROM t WHERE id = (SELECT java_method('java.lang.Math', 'abs', 1))", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM other",
    "SELECT id FROM t WHERE EXISTS (SELECT * FROM text.`/etc/hosts`)", "WITH x AS (SELECT * FROM csv.`/tmp/x`) SELECT * FROM x"])
def test_query_select_refuses(spark, sql):
    with pytest.raises(staging.QueryRejectedError):
        staging.query_select(spark, sql, {"t": spark.range(3)}, max_rows=100)


def test_query_select_leaves_views_alone(spark):
    spark.range(7).createOrReplaceTempView("mine")
    out, _ = staging.query_select(spark, "SELECT count(*) AS n FROM mine", {"mine": spark.range(3)}, max_rows=5)
    assert out.first()["n"] == 3 and spark.table("mine").count() == 7
    assert [v.name for v in spark.catalog.listTables() if v.name.startswith("q_")] == []
    spark.catalog.dropTempView("mine")


def test_query_select_truncates(spark):
    out, more = staging.query_select(spark, "SELECT id FROM t", {"t": spark.range(11)}, max_rows=10)
    assert out.count() == 10 and more.first()["truncated"] is True


def test_models_failures_and_cycles(spark):
    good = staging.Model("a", "SELECT id FROM {t}", ("t",))
    bad = staging.Model("b", "SELECT nope FROM {a}", ("a",))
    after = staging.Model("c", "SELECT * FROM {b}", ("b",))
    built, errors = staging.run_models(spark, [after, bad, good], {"t": spark.range(3)})
    assert built["a"].count() == 3 and set(errors) == {"b", "c"} and errors["c"].startswith("skipped")
    with pytest.raises(ValueError):
        staging.model_order([staging.Model("x", "", ("y",)), staging.Model("y", "", ("x",))], [])
    assert [m.name for m in staging.model_order([good, bad, after], ["t"], "a+")] == ["a", "b", "c"]


# --- files ------------------------------------------------------------------------------


def write_text(spark, path, *lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "file1.csv").write_text("id,name\n1,Alice\n2,Bob\n")
    return tmp_path


SCHEMA = "id int, name string"


def loader(spark, folder, schema=SCHEMA):
    return FileLoader(spark, "people", str(folder), new_folder(spark, "people"), spark.createDataFrame([], schema).schema)


def test_strict_load_refuses_other_columns(spark, landing):
    load_ = loader(spark, landing)
    load_.sync(T1)
    (landing / "file2.csv").write_text("id,name,email\n3,Charlie,c@x.com\n")
    with pytest.raises(SchemaMismatchError, match="file2.csv: extra \\['email'\\]"):
        load_.sync(T2)
    assert load_.table().count() == 2


def test_evolved_read_pads_with_null(spark, landing):
    (landing / "file2.csv").write_text("id,name,email\n3,Charlie,c@x.com\n")
    schema = files.infer_schema(spark, str(landing))
    out = files.scan_files(spark, str(landing), schema)
    assert sorted((r["id"], r["email"]) for r in out.collect()) == [(1, None), (2, None), (3, "c@x.com")]
    with pytest.raises(ValueError):
        files.evolve_schema(out, out.drop("email"), opt_in=False)
    with pytest.raises(ValueError):
        files.merge_schemas(schema, out.select(F.col("id").cast("string")).schema)


def test_evolving_load(spark, landing):
    load_ = loader(spark, landing)
    load_.sync(T1)
    (landing / "file2.csv").write_text("id,name,email\n3,Charlie,c@x.com\n")
    load_.sync(T2, evolve=True)
    assert sorted((r["id"], r["email"]) for r in load_.table().collect()) == [(1, None), (2, None), (3, "c@x.com")]
    # The grown schema is found again, and then the file's columns are the table's.
    again = FileLoader(spark, "people", str(landing), load_.path, spark.createDataFrame([], SCHEMA).schema)
    (landing / "file3.csv").write_text("id,name,email\n4,Dan,\n")
    again.sync(T3)
    assert again.table().count() == 4


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"id": 1,\n "name": "x"},\n {"id": 2}\n]')
    (tmp_path / "b.json").write_text('{\n"id": 3\n}')
    columns = files.file_columns(spark, str(tmp_path), multiline=True)
    assert {r["file_path"]: r["columns"] for r in columns.collect()} == {"a.json": ["id", "name"], "b.json": ["id"]}
    load_ = FileLoader(spark, "people", str(tmp_path), new_folder(spark, "people"), spark.createDataFrame([], SCHEMA).schema, multiline=True)
    load_.sync(T1, evolve=True)
    assert sorted((r["id"], r["name"]) for r in load_.table().collect()) == [(1, "x"), (2, None), (3, None)]


def test_column_order_of_csv_does_not_matter(spark, landing):
    (landing / "file2.csv").write_text('name,id\n"Smith, J",3\n')
    load_ = loader(spark, landing)
    load_.sync(T1)
    assert sorted((r["id"], r["name"]) for r in load_.table().collect()) == [(1, "Alice"), (2, "Bob"), (3, "Smith, J")]


def test_file_life_cycle(spark, landing):
    load_ = loader(spark, landing)

    def states(outcome):
        return {r["file_path"]: (r["state"], r["rows_loaded"]) for r in outcome.collect()}

    (landing / "a b+c%.jsonl").write_text('{"id": 7, "name": "Seven"}\n')
    (landing / "notes.txt").write_text("skipped")
    assert states(load_.sync(T1)) == {"file1.csv": ("new", 2), "a b+c%.jsonl": ("new", 1)}
    assert {s for s, _ in states(load_.sync(T2)).values()} == {"unchanged"}
    # Changed: its rows are replaced. Emptied: the old version stays.
    import os
    import time

    later = time.time() + 100
    (landing / "file1.csv").write_text("id,name\n5,Eve\n")
    os.utime(landing / "file1.csv", (later, later))
    (landing / "empty.csv").write_text("id,name\n")
    out = states(load_.sync(T3))
    assert out["file1.csv"] == ("updated", 1) and out["empty.csv"] == ("new", 0)
    assert sorted(r["id"] for r in load_.table().collect()) == [5, 7]
    assert "empty.csv" not in {r["file_path"] for r in load_.ledger().collect()}
    (landing / "file1.csv").write_text("id,name\n")
    os.utime(landing / "file1.csv", (later + 100, later + 100))
    assert states(load_.sync(datetime(2026, 1, 4)))["file1.csv"] == ("updated", 0)
    assert sorted(r["id"] for r in load_.table().collect()) == [5, 7]
    # Gone: its rows disappear, and it is not deleted again by the next run.
    (landing / "a b+c%.jsonl").rename(landing / "kept.txt")
    assert states(load_.sync(datetime(2026, 1, 5)))["a b+c%.jsonl"][0] == "deleted"
    assert sorted(r["id"] for r in load_.table().collect()) == [5]
    assert "a b+c%.jsonl" not in states(load_.sync(datetime(2026, 1, 6)))
    # Back: it is new again.
    (landing / "kept.txt").rename(landing / "a b+c%.jsonl")
    assert states(load_.sync(datetime(2026, 1, 7)))["a b+c%.jsonl"] == ("new", 1)


def test_file_columns_of_all_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x, y",z\n1,2\n')
    (tmp_path / "b.ndjson").write_text('{"z": 1}\n{"w": 2}\n')
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "c"))
    out = {r["file_path"].split("/")[0].split(".")[0]: r["columns"] for r in files.file_columns(spark, str(tmp_path)).collect()}
    assert out == {"a": ["x, y", "z"], "b": ["w", "z"], "c": ["id"]}


def test_load_summary_reports_nothing_loaded(spark):
    outcome = spark.createDataFrame([("a", "new", 0), ("b", "unchanged", None)], "file_path string, state string, rows_loaded bigint")
    total = spark.range(0).agg(F.count(F.lit(1)).alias("n"))
    out = file_load.load_summary(outcome, total).first()
    assert (out["status"], out["skipped"], out["new"]) == ("error", 2, 0)


def test_partial_load_statuses(spark):
    def fail():
        raise RuntimeError("no connection")

    seen = {}
    out = load.partial_load(spark, {"a": lambda: spark.range(1), "b": fail}, lambda n, df: seen.update({n: df.count()}))
    assert {(r["table_name"], r["status"], r["error"], r["load_status"]) for r in out.collect()} == {("a", "loaded", None, "partial"), ("b", "failed", "no connection", "partial")}
    assert seen == {"a": 1}


def test_work_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert work_folder(spark) == configured.rstrip("/")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_types_widen_over_loads(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.LongType()), T.StructField("zip", T.StringType())])
    loader = FileLoader(spark, "s", str(folder), new_folder(spark, "wide"), schema)
    (folder / "a.csv").write_text("id,v,zip\n1,10,00123\n")
    loader.sync(datetime(2024, 1, 1), evolve=True)
    assert loader.schema == schema
    (folder / "b.csv").write_text("id,v,zip\n3000000000,2.5,456\n")
    (folder / "c.csv").write_text("v,id,zip\n7,2,789\n")
    loader.sync(datetime(2024, 1, 2), evolve=True)
    again = FileLoader(spark, "s", str(folder), loader.path, schema)
    assert [f.dataType.simpleString() for f in again.schema.fields] == ["bigint", "double", "string"]
    want = [(1, 10.0, "00123"), (2, 7.0, "789"), (3000000000, 2.5, "456")]
    assert sorted((r["id"], r["v"], r["zip"]) for r in again.table().collect()) == want
    (folder / "a.csv").write_text("id,v,zip\n5,1,0\n")
    changed = again.listing().withColumn("file_mtime", F.expr("file_mtime + INTERVAL 1 DAY")).where("file_path = 'a.csv'")
    assert again.sync(datetime(2024, 1, 3), changed, evolve=True).where("rows_loaded = 1").count() == 1
    with pytest.raises((ValueError, PySparkException)):
        (folder / "d.csv").write_text("id,v,zip\nword,1,0\n")
        again.sync(datetime(2024, 1, 4), evolve=True)


def test_evolve_widens_numbers(spark):
    a, b = spark.createDataFrame([(1, 5)], "id int, n bigint"), spark.createDataFrame([(3000000000, 0.5, "x")], "id bigint, n double, s string")
    out = files.evolve_schema(a, b)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "double", "string"]
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, None), (3000000000, 0.5, "x")]


@pytest.mark.parametrize("values", ["pow(id, 4)", "id % 3", "IF(id < 500, 7, id)", "CAST(NULL AS BIGINT)", "timestamp_seconds(id * id)", "date_add(DATE '2024-01-01', CAST(id % 90 AS INT))"])
def test_ranges_of_equal_depth(spark, values):
    rows = spark.range(2000).selectExpr("id", f"IF(id % 10 = 0, NULL, {values}) AS k")
    path = new_folder(spark, "ranges")
    rows.write.parquet(f"{path}/t")
    ranges = files.snapshot_ranges(rows, "k", 8)
    sizes = [rows.where(p).count() for p in ranges]
    assert sum(sizes) == 2000
    if values in ("pow(id, 4)", "timestamp_seconds(id * id)"):
        assert max(sizes[:-1]) <= 2 * 1800 / 8
    out = files.scan_ranges(spark, path, "t", "k", 8, fmt="parquet")
    assert out.count() == 2000 and out.exceptAll(rows).isEmpty()
