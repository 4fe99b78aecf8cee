"""Streams over events: as messages, as arriving files, as visits and as metrics.

The file source stands in for a broker. A glob is used as the path, since the source takes a
single file only that way; it works for a folder of part files too.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.plans.monitors import EXACT, exact_sum
from millrace.plans.registry import Tables, query
from millrace.session import new_folder
from millrace.sources.file_load import FileLoader
from millrace.streaming import streams
from millrace.streaming.arrivals import Arrivals, load_settled
from millrace.streaming.message_log import MessageLog


def events_stream(t: Tables) -> DataFrame:
    return streams.file_stream(t.spark, f"{t.path('events')}*", t.events.schema)


def as_messages(events: DataFrame) -> DataFrame:
    """Events as messages of one topic per type and eight partitions each."""
    return events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 8).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.when(F.col("value") < 50, F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


@query("stream_bounded_read", "SELECT event_type AS topic, count(*) AS messages, min(event_id) AS first_offset, max(event_id) AS last_offset FROM events GROUP BY 1")
def _stream_bounded_read(t: Tables) -> DataFrame:
    path, checkpoint = new_folder(t.spark, "topics"), new_folder(t.spark, "offsets")
    messages = as_messages(events_stream(t))
    streams.stream_bounded_read(messages, path, checkpoint)
    # The second run starts from the saved offsets and finds nothing new.
    streams.stream_bounded_read(messages, path, checkpoint)
    loaded = t.spark.read.parquet(path)
    return loaded.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query(
    "stream_envelope",
    """
SELECT event_type AS topic, CAST(user_id % 8 AS INTEGER) AS partition, event_id AS offset_, CASE WHEN value < 50 THEN CAST(user_id AS VARCHAR) END AS key, ts,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       sha256(array_to_string(list_transform([event_type, CAST(user_id % 8 AS VARCHAR), CASE WHEN value < 50 THEN CAST(user_id AS VARCHAR) ELSE '' END,
                                              CAST(event_id AS VARCHAR)], lambda x: length(x) || ':' || x), '')) AS message_id
FROM events
""",
)
def _stream_envelope(t: Tables) -> DataFrame:
    out = streams.stream_envelope(as_messages(t.events), lambda data: F.from_json(data, "k int"))
    return out.select(
        "message.topic", "message.partition", F.col("message.offset").alias("offset_"), "message.key",
        F.col("message.ts").cast("timestamp_ntz").alias("ts"), "message.data.k", "message_id",
    )


@query(
    "stream_offsets_state",
    """
SELECT event_type AS unit, CAST(user_id % 8 AS VARCHAR) AS part, CAST(max(event_id) AS VARCHAR) AS last_position FROM events GROUP BY ALL
UNION ALL SELECT 'shard', CAST(l_suppkey AS VARCHAR), CAST(max(l_orderkey) AS VARCHAR) FROM lineitem GROUP BY ALL
""",
)
def _stream_offsets_state(t: Tables) -> DataFrame:
    topics = streams.stream_offsets_state(as_messages(t.events))
    # Sequence numbers of shards are text; as text 9 would come after 10.
    shards = t.lineitem.select(F.col("l_suppkey").cast("string").alias("shard"), F.col("l_orderkey").cast("string").alias("sequence"))
    last = streams.stream_offsets_state(shards, ["shard"], "sequence")
    a = topics.select(F.col("topic").alias("unit"), F.col("partition").cast("string").alias("part"), F.col("last_position").cast("string"))
    return a.unionByName(last.select(F.lit("shard").alias("unit"), F.col("shard").alias("part"), "last_position"))


@query("stream_dedup", "SELECT count(*) AS messages, count(DISTINCT event_id) AS distinct_messages FROM events")
def _stream_dedup(t: Tables) -> DataFrame:
    # Every message is delivered twice, as after a retry.
    path, checkpoint = new_folder(t.spark, "once"), new_folder(t.spark, "offsets")
    twice = as_messages(events_stream(t)).withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    once = streams.stream_dedup(twice, "30 days")
    streams.run(once.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
    loaded = t.spark.read.parquet(path)
    return loaded.agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("offset").alias("distinct_messages"))


def arriving(t: Tables) -> tuple[str, DataFrame]:
    """Events as files of a landing folder, a folder per third of the month, and their rows."""
    rows = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    landing = new_folder(t.spark, "landing")
    for part in range(3):
        rows.where(F.floor((F.dayofmonth("ts") - 1) / 10) == part).write.mode("append").parquet(landing)
    return landing, rows


@query("stream_files", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _stream_files(t: Tables) -> DataFrame:
    landing, rows = arriving(t)
    path, checkpoint = new_folder(t.spark, "arrived"), new_folder(t.spark, "offsets")
    # One file per batch, then the same rows again as a second delivery.
    source = streams.file_stream(t.spark, landing, rows.schema, files_per_batch=1)
    streams.stream_files(source, path, checkpoint, ["event_id"], "day", ["ts"])
    rows.where("event_type = 'view'").write.mode("append").parquet(landing)
    streams.stream_files(source, path, checkpoint, ["event_id"], "day", ["ts"])
    return streams.merged(t.spark, path, ["event_id"], "day").select(*t.events.columns)


@query(
    "lag_merge_stream",
    """
SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, max(ts) AS ts FROM events
WHERE day(ts) >= 21 OR ts >= (SELECT max(ts) FROM events WHERE day(ts) >= 21) - INTERVAL 15 DAY GROUP BY ALL
""",
)
def _lag_merge_stream(t: Tables) -> DataFrame:
    rows = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    landing, path, checkpoint = (new_folder(t.spark, x) for x in ("landing", "merged", "offsets"))
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    # The last third of the month comes first; of the others the lag lets in what is not too old.
    for part in (2, 0, 1):
        rows.where(third == part).write.mode("append").parquet(landing)
        source = streams.file_stream(t.spark, landing, rows.schema, files_per_batch=2)
        latest = source.select("user_id", "day", F.col("ts").cast("timestamp").alias("ts"))
        streams.lag_merge_stream(latest, path, checkpoint, ["user_id", "day"], "day", "ts", "15 days")
    merged = streams.merged(t.spark, path, ["user_id", "day"], "day")
    return merged.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


VISITS = """
gaps AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM gaps),
visits AS (SELECT user_id, CAST(user_id % 5 AS BIGINT) AS site, n, min(ts) AS first_action, max(ts) AS last_action, min(event_id) AS visit_id, count(*) AS actions FROM numbered GROUP BY ALL),
clock AS (SELECT max(ts) + INTERVAL 10 MINUTE AS now_ FROM events),
marked AS (
  SELECT v.*, epoch_us(now_) - epoch_us(last_action) < 1800000000 AND epoch_us(now_) - epoch_us(first_action) < 3600000000 AS active FROM visits v, clock)
"""


@query(
    "closed_sessions",
    f"""
WITH {VISITS},
cut AS (SELECT site, min(first_action) FILTER (active) AS at_ FROM marked GROUP BY 1)
SELECT user_id, site, first_action, last_action, visit_id, actions FROM marked JOIN cut USING (site) WHERE at_ IS NULL OR first_action < at_
""",
)
def _closed_sessions(t: Tables) -> DataFrame:
    stamped = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    visits = streams.sessions(stamped, ["user_id"], "ts", "30 minutes", F.min("event_id").alias("visit_id"), F.count(F.lit(1)).alias("actions"))
    now = stamped.agg((F.max("ts") + F.make_dt_interval(mins=F.lit(10))).alias("n")).scalar()
    sites = visits.withColumn("site", F.col("user_id") % 5)
    out = streams.closed_sessions(sites, ["site"], ["first_action", "visit_id"], now)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_action", "last_action")})


@query(
    "stream_metrics",
    f"SELECT event_type AS metric_name, {EXACT} AS metric_value, CAST(date_trunc('day', ts) AS TIMESTAMP) AS recorded_at FROM events GROUP BY event_type, date_trunc('day', ts)",
)
def _stream_metrics(t: Tables) -> DataFrame:
    path, checkpoint = new_folder(t.spark, "history"), new_folder(t.spark, "offsets")
    rows = events_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.stream_metrics(rows, "ts", [F.col("event_type")], exact_sum("value"), "1 day", "2 days", path, checkpoint)
    out = streams.merged(t.spark, path, ["metric_name", "recorded_at"], "month")
    return out.select("metric_name", "metric_value", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


@query(
    "stream_sessions",
    f"""
WITH {VISITS}
SELECT user_id, CAST(n AS BIGINT) AS visit, first_action, last_action, visit_id, actions
FROM visits WHERE last_action + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY
""",
)
def _stream_sessions(t: Tables) -> DataFrame:
    """A file stream in three deliveries; a fifth of the events of the first days of a third comes with the next one."""
    landing, path, checkpoint = (new_folder(t.spark, x) for x in ("landing", "visits", "offsets"))
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    third = (F.unix_micros("last") - F.unix_micros("first")) / 3 + 1
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("_at", (F.unix_micros("ts") - F.unix_micros("first")) / third)
    # late by less than a day, which the watermark of two days waits for
    late = (F.col("event_id") % 5 == 0) & ((F.floor("_at") + 1 - F.col("_at")) * third < 86_400_000_000)
    dealt = dealt.withColumn("_delivery", F.least(F.floor("_at") + F.when(late, 1).otherwise(0), F.lit(2)))
    for delivery in range(3):
        dealt.where(F.col("_delivery") == delivery).select(*rows.columns).write.mode("append").parquet(landing)
        source = streams.file_stream(t.spark, landing, rows.schema)
        aggregates = F.min("event_id").alias("visit_id"), F.count(F.lit(1)).alias("actions")
        streams.stream_sessions(source, ["user_id"], "ts", "30 minutes", "2 days", path, checkpoint, *aggregates)
    visits = t.spark.read.schema("user_id bigint, first_action timestamp, last_action timestamp, visit_id bigint, actions bigint").parquet(path)
    number = F.row_number().over(W.partitionBy("user_id").orderBy("first_action")).cast("bigint")
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("first_action", "last_action")}
    return visits.withColumn("visit", number).withColumns(plain)


@query(
    "stream_files_quiet",
    """
SELECT event_id, ts, user_id, event_type, value, props,
       CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-01-01 00:15:00' ELSE TIMESTAMP '2024-01-01 00:10:00' END AS loaded_at
FROM events
""",
)
def _stream_files_quiet(t: Tables) -> DataFrame:
    """Folders of part files, one of which still grows at the second poll: it is loaded once, whole, when it has settled."""
    landing, path = new_folder(t.spark, "landing"), new_folder(t.spark, "settled")
    first, half = datetime(2024, 1, 1), F.col("event_id") % 2 == 0
    growing = F.col("event_type") == "view"
    arrivals = Arrivals(t.spark, landing, path, "10 minutes", unit="folder")
    loader = FileLoader(t.spark, "app", landing, path, t.events.schema, unit="folder")

    def deliver(rows: DataFrame) -> None:
        rows.withColumn("unit", F.col("event_type")).write.mode("append").partitionBy("unit").parquet(landing)

    deliver(t.events.where(~growing | half))
    load_settled(loader, arrivals, first)
    deliver(t.events.where(growing & ~half))
    for minutes in (5, 10, 15, 20):
        load_settled(loader, arrivals, first + timedelta(minutes=minutes))
    return loader.table().select(*t.events.columns, F.col("_src_loaded_at").alias("loaded_at"))


@query(
    "stream_bounded_times",
    """
WITH m AS (SELECT event_type AS topic, CAST(user_id % 8 AS INTEGER) AS partition, event_id AS offset_, ts FROM events),
span AS (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS a, min(ts) + (max(ts) - min(ts)) / 2 AS b FROM events),
bounds AS (SELECT topic, partition, min(offset_) FILTER (ts >= a) AS lo, min(offset_) FILTER (ts >= b) AS hi FROM m, span GROUP BY ALL)
SELECT topic, partition, offset_, ts FROM m JOIN bounds USING (topic, partition) WHERE offset_ >= lo AND (hi IS NULL OR offset_ < hi)
""",
)
def _stream_bounded_times(t: Tables) -> DataFrame:
    folder, path = new_folder(t.spark, "log"), new_folder(t.spark, "log-index")
    log = MessageLog(t.spark, folder, path)
    # Segments by offset; the index takes those of the second delivery when it is refreshed.
    messages = as_messages(t.events)
    for even in (True, False):
        part = messages.where((F.floor(F.col("offset") / 1000) % 2 == 0) == even)
        part.repartitionByRange(4, "offset").write.mode("append").parquet(folder)
        log.refresh()
    span = t.events.agg(F.min("ts"), F.max("ts")).first()
    if span[0] is None:
        read = log.read()
    else:
        read = log.read(span[0] + (span[1] - span[0]) / 4, span[0] + (span[1] - span[0]) / 2)
    return read.select("topic", "partition", F.col("offset").alias("offset_"), F.col("timestamp").cast("timestamp_ntz").alias("ts"))
