"""Large CSV files read in splits: the same rows as by one task, whatever the cells hold."""

from __future__ import annotations

import csv
import io
import os
import random
import subprocess
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import files as file_plans
from millrace.plans.registry import Tables
from millrace.session import new_folder
from millrace.sources import csv_records, files
from millrace.sources.file_load import FileLoader

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType())])


@pytest.fixture
def small_splits(spark):
    for name, value in (("maxPartitionBytes", "3000b"), ("openCostInBytes", "10")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@given(st.lists(st.lists(st.text("a,\"\n ", max_size=8), min_size=2, max_size=3), max_size=6))
def test_line_states_follow_the_writer(rows):
    text = io.StringIO()
    csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    inside, records = False, 0
    for line in text.getvalue().split("\n")[:-1]:
        inside = csv_records.ends_inside(line, inside)
        records += not inside
    assert records == len(rows) and not inside


@pytest.mark.parametrize(
    ("line", "out", "in_"),
    [
        ("a,b", False, True),
        ('"a', True, False),
        ('a,"b', True, False),
        ('5" pipe,b', False, False),
        ('"a""', True, False),
        ('x",b', False, False),
        ('x","b', True, True),
        ('"a"b,"c', True, True),
        ("", False, True),
    ],
)
def test_line_states(line, out, in_):
    assert (csv_records.ends_inside(line, False), csv_records.ends_inside(line, True)) == (out, in_)


def cell(rng):
    kind = rng.random()
    if kind < 0.4:
        return rng.choice(["a", "b c", "x" * 30, "", "7"])
    if kind < 0.6:
        return rng.choice(['st"ray', 'mid "q" x'])
    if kind < 0.95:
        return '"' + "".join(rng.choice(["a", "\n", '""', ",", "é", "\n\n", " ", "word\n"]) for _ in range(rng.randint(0, 40))) + '"'
    return '"' + "long\n" * rng.randint(10, 800) + '"'  # longer than a split


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_same_rows_by_many_tasks(spark, tmp_path, small_splits, newline):
    rng = random.Random(3)
    for k in range(2):
        with open(tmp_path / f"f [{k}]+x.csv", "w", newline="", encoding="utf-8") as file:
            file.write(f"a,b,c{newline}")
            for i in range(600):
                file.write(f"{cell(rng)},{cell(rng)},{i}{newline}" + newline * (rng.random() < 0.02))
    whole = files.scan_files(spark, str(tmp_path), SCHEMA, provenance=True, split_from=1 << 40)
    split = files.scan_files(spark, str(tmp_path), SCHEMA, provenance=True)
    paths = [files.literal(str(p)) for p in tmp_path.iterdir()]
    assert csv_records._lines(spark, paths).rdd.getNumPartitions() > 50
    assert split.count() == 1200
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()


def test_only_large_files_are_split(spark, tmp_path, small_splits):
    (tmp_path / "small.csv").write_text("a,b,c\nx,y,1\n")
    (tmp_path / "large.csv").write_text("a,b,c\n" + "x,y,1\n" * 1000)
    (header,) = files.csv_headers(spark, [str(tmp_path)])
    assert [p.rsplit("/", 1)[1] for p in header["paths"] + header["large"]] == ["small.csv", "large.csv"]
    assert files.scan_files(spark, str(tmp_path), SCHEMA).count() == 1001


def test_a_bad_cell_fails_a_split_read(spark, tmp_path, small_splits):
    (tmp_path / "large.csv").write_text("a,b,c\n" + "x,y,1\n" * 1000 + "x,y,word\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.scan_files(spark, str(tmp_path), SCHEMA).collect()


def test_load_of_a_large_file(spark, tmp_path, small_splits):
    (tmp_path / "large.csv").write_text("a,b,c\n" + 'x,"y\nz",1\n' * 1000)
    loader = FileLoader(spark, "s", str(tmp_path), new_folder(spark, "loaded"), SCHEMA)
    outcome = loader.sync(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).collect()
    assert [(r["file_path"], r["rows_loaded"]) for r in outcome] == [("large.csv", 1000)]
    assert loader.table().where("b = 'y\nz'").count() == 1000


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A session started elsewhere, with the package on the driver's path only."""
    (tmp_path / "a.csv").write_text("a,b,c\nx,y,1\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
from millrace.sources import files
assert files.csv_headers(spark, [{str(tmp_path)!r}])[0]["columns"] == ["a", "b", "c"]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True, timeout=180)


def test_split_query_writes_no_table_by_one_task(spark, tmp_path, small_splits, monkeypatch):
    text = F.concat(F.lit('line\n"quoted", '), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20))
    rows = spark.range(0, 160, 1, 8).select("id", text.alias("text"))
    rows.select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    folders = []
    monkeypatch.setattr(file_plans, "new_folder", lambda spark, label: folders.append(new_folder(spark, label)) or folders[-1])
    out = file_plans._scan_files_split(spark, str(tmp_path))
    want = Tables(spark, str(tmp_path)).documents.select("doc_id", "lang", "source", F.concat(F.lit('say "x", '), "text").alias("text"))
    assert out.count() == 160 and out.exceptAll(want).isEmpty()
    written = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folders[0]).select("length").collect()
    assert len(written) > 3 and min(r["length"] for r in written) > 3000
