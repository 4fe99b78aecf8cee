"""Streams over files in the shared folder, run until they are used up."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import new_folder
from millrace.sources.file_load import FileLoader
from millrace.streaming import streams
from millrace.streaming.arrivals import Arrivals, load_settled, watch
from millrace.streaming.message_log import MessageLog

T0 = datetime(2026, 1, 1)


def messages(spark, *rows):
    return spark.createDataFrame([(t, p, o, k, v, T0 + timedelta(minutes=m)) for t, p, o, k, v, m in rows], streams.MESSAGE)


def test_bounded_read_goes_on_after_its_offsets(spark):
    landing, path, checkpoint = (new_folder(spark, n) for n in ("in", "out", "offsets"))
    messages(spark, ("a", 0, 1, "k", "x", 0), ("b", 0, 1, None, "y", 0)).write.parquet(landing)
    source = streams.file_stream(spark, landing, messages(spark).schema)
    streams.stream_bounded_read(source, path, checkpoint)
    messages(spark, ("a", 0, 2, "k", "z", 1)).write.mode("append").parquet(landing)
    for _ in range(2):
        streams.stream_bounded_read(source, path, checkpoint)
    assert sorted((r["topic"], r["offset"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_dedup_across_batches(spark):
    landing, path, checkpoint = (new_folder(spark, n) for n in ("in", "out", "offsets"))
    for _ in range(2):
        messages(spark, ("a", 0, 1, "k", "x", 0), ("a", 0, 2, "k", "x", 1), ("a", 1, 1, "k", "x", 2)).write.mode("append").parquet(landing)
        source = streams.file_stream(spark, landing, messages(spark).schema)
        writer = streams.stream_dedup(source).writeStream.format("parquet").option("path", path)
        streams.run(writer, checkpoint)
    assert spark.read.parquet(path).count() == 3


def test_state_compares_numbers_and_finds_one_unread(spark):
    shards = spark.createDataFrame([("s", "9"), ("s", "10"), ("t", "49590338271490256608559692538361571095921575989136588898")], "shard string, sequence string")
    out = {r["shard"]: r["last_position"] for r in streams.stream_offsets_state(shards, ["shard"], "sequence").collect()}
    assert out == {"s": "10", "t": "49590338271490256608559692538361571095921575989136588898"}
    state = streams.stream_offsets_state(messages(spark, ("a", 0, 4, None, "x", 0)))
    newest = streams.stream_offsets_state(messages(spark, ("a", 0, 5, None, "x", 0), ("a", 1, 0, None, "x", 0)))
    assert sorted((r["partition"], r["unread"]) for r in streams.unread(state, newest).collect()) == [(0, 1), (1, 1)]


def test_lag_leaves_old_rows_out(spark):
    landing, path, checkpoint = (new_folder(spark, n) for n in ("in", "out", "offsets"))
    schema = "id int, v string, ts timestamp, day string"

    def deliver(*rows):
        df = spark.createDataFrame([(i, v, T0 + timedelta(days=d), f"d{d:03}") for i, v, d in rows], schema)
        df.coalesce(1).write.mode("append").parquet(landing)
        source = streams.file_stream(spark, landing, df.schema)
        streams.lag_merge_stream(source, path, checkpoint, ["id", "day"], "day", "ts", "3 days")

    deliver((1, "a", 0), (2, "b", 10))
    deliver((3, "late", 8), (4, "too late", 6), (2, "again", 10))
    out = streams.merged(spark, path, ["id", "day"], "day")
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "a"), (2, "again"), (3, "late")]


def test_closed_visits(spark):
    now = T0 + timedelta(hours=10)

    def visit(site, i, first, last):
        return (site, i, now - timedelta(seconds=first), now - timedelta(seconds=last))

    rows = [
        visit(1, 1, 9000, 8000),
        visit(1, 2, 3000, 100),  # active: the oldest one
        visit(1, 3, 2500, 2000),  # over, but newer than the active one
        visit(1, 4, 10, 5),
        visit(2, 5, 5000, 100),  # too long to be active
        visit(3, 6, 2000, 1800),  # timed out
    ]
    df = spark.createDataFrame(rows, "site int, id int, first_action timestamp_ntz, last_action timestamp_ntz")
    out = streams.closed_sessions(df, ["site"], ["first_action", "id"], F.lit(now).cast("timestamp_ntz"))
    assert sorted(r["id"] for r in out.collect()) == [1, 5, 6]


def test_sessions_of_a_hot_user(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("u"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))).cast("timestamp").alias("ts"))
    out = streams.sessions(df, ["u"], "ts", "30 minutes", F.count(F.lit(1)).alias("n"))
    assert out.agg(F.sum("n")).first()[0] == 9000
    assert out.where("u = 0").count() == 1


def test_metric_stream_equals_batch_after_two_runs(spark):
    landing, path, checkpoint = (new_folder(spark, n) for n in ("in", "out", "offsets"))
    schema = "kind string, ts timestamp, value double"
    rows = [("a", T0 + timedelta(hours=h), float(h)) for h in range(60)]
    for part in (rows[:20], rows[20:]):
        df = spark.createDataFrame(part, schema)
        df.write.mode("append").parquet(landing)
        source = streams.file_stream(spark, landing, df.schema)
        streams.stream_metrics(source, "ts", [F.col("kind")], F.sum("value"), "1 day", "2 days", path, checkpoint)
    out = streams.merged(spark, path, ["metric_name", "recorded_at"], "month")
    assert sorted(r["metric_value"] for r in out.collect()) == sorted([sum(range(24)) * 1.0, sum(range(24, 48)) * 1.0, sum(range(48, 60)) * 1.0])


def test_sessions_over_deliveries(spark):
    landing, path, checkpoint = (new_folder(spark, n) for n in ("in", "visits", "offsets"))

    def deliver(*minutes):
        df = spark.createDataFrame([("u", T0 + timedelta(minutes=m)) for m in minutes], "u string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(landing)
        source = streams.file_stream(spark, landing, df.schema)
        streams.stream_sessions(source, ["u"], "ts", "30 minutes", "1 hour", path, checkpoint, F.count(F.lit(1)).alias("n"))
        visits = spark.read.schema("u string, first_action timestamp, last_action timestamp, n bigint").parquet(path)
        return sorted((r["first_action"] - T0, r["n"]) for r in visits.collect())

    # the visit is open at the end of the first delivery, goes on in the second, and takes a late event
    assert deliver(0, 10, 20) == []
    assert deliver(45, 60, 30, 120) == []
    assert deliver(160, 1000) == [(timedelta(0), 6), (timedelta(minutes=120), 1), (timedelta(minutes=160), 1)]
    assert deliver(5, 1010)[0] == (timedelta(0), 6)  # too late


def landing_of(spark, tmp_path, quiet="10 minutes"):
    folder, path = tmp_path / "in", new_folder(spark, "settled")
    folder.mkdir()
    loader = FileLoader(spark, "s", str(folder), path, T.StructType([T.StructField("a", T.IntegerType())]))
    return folder, loader, Arrivals(spark, str(folder), path, quiet)


def test_a_growing_file_is_loaded_once_and_whole(spark, tmp_path):
    folder, loader, arrivals = landing_of(spark, tmp_path)
    (folder / "x.csv").write_text("a\n1\n")
    (folder / "y.csv").write_text("a\n7\n")
    loaded = {}
    for minute, text in ((0, None), (6, "a\n1\n2\n"), (12, "a\n1\n2\n3\n"), (20, None), (22, None), (40, None)):
        if text:
            (folder / "x.csv").write_text(text)
        out = load_settled(loader, arrivals, T0 + timedelta(minutes=minute)).collect()
        loaded[minute] = {r["file_path"]: r["rows_loaded"] for r in out if r["state"] in ("new", "updated")}
    assert loaded == {0: {}, 6: {}, 12: {"y.csv": 1}, 20: {}, 22: {"x.csv": 3}, 40: {}}
    assert sorted(r["a"] for r in loader.table().collect()) == [1, 2, 3, 7]


def test_a_loaded_file_that_changes_keeps_its_rows_meanwhile(spark, tmp_path):
    folder, loader, arrivals = landing_of(spark, tmp_path)
    (folder / "x.csv").write_text("a\n1\n")
    for minute in (0, 10):
        load_settled(loader, arrivals, T0 + timedelta(minutes=minute))
    (folder / "x.csv").write_text("a\n1\n2\n")
    load_settled(loader, arrivals, T0 + timedelta(minutes=11))
    assert loader.table().count() == 1
    load_settled(loader, arrivals, T0 + timedelta(minutes=21))
    assert loader.table().count() == 2
    (folder / "x.csv").unlink()
    load_settled(loader, arrivals, T0 + timedelta(minutes=22))
    assert loader.table().count() == 0


def test_watch_polls_as_a_stream(spark, tmp_path):
    folder, loader, arrivals = landing_of(spark, tmp_path, "0 seconds")
    (folder / "x.csv").write_text("a\n1\n")
    watch(loader, arrivals, new_folder(spark, "ticks"), "1 second", 15)
    assert loader.table().count() == 1


def test_bounded_read_opens_only_the_files_it_needs(spark, tmp_path):
    folder = tmp_path / "log"
    for k in range(6):
        rows = [("a", 0, 10 * k + i, None, "x", 10 * k + i) for i in range(10)]
        messages(spark, *rows).coalesce(1).write.parquet(str(folder / f"s{k}"))
    log = MessageLog(spark, str(folder), new_folder(spark, "index"))
    log.refresh()
    log.refresh()
    assert log.index().count() == 6
    for k in (0, 1, 4, 5):  # files outside of the span cannot be read any more
        for part in (folder / f"s{k}").glob("*.parquet"):
            part.write_bytes(b"no parquet")
    span = T0 + timedelta(minutes=22), T0 + timedelta(minutes=35)
    assert sorted(r["offset"] for r in log.read(*span).collect()) == list(range(22, 35))
    assert {r["path"].rsplit("/s", 1)[1][0] for r in log.index().collect()} == set("012345")


def test_bounded_read_of_times_out_of_order(spark):
    folder = new_folder(spark, "log")
    # from the first message at or after the start to the one before the first at or after the end, as a broker does
    minutes = [0, 5, 3, 9, 4, 20, 6, 30]
    messages(spark, *[("a", 0, i, None, "x", m) for i, m in enumerate(minutes)], ("b", 1, 0, None, "y", 1)).write.parquet(folder)
    log = MessageLog(spark, folder, new_folder(spark, "index"))
    assert log.read().count() == 0
    log.refresh()

    def offsets(start, end):
        at = [None if m is None else T0 + timedelta(minutes=m) for m in (start, end)]
        return sorted((r["topic"], r["offset"]) for r in log.read(*at).collect())

    assert offsets(5, 10) == [("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert offsets(None, 4) == [("a", 0), ("b", 0)]
    assert offsets(31, None) == [] and len(offsets(None, None)) == 9
