"""Structured Streaming: bounded reads of message logs, file arrival, upserts and metrics.

Every stream takes its offsets from the checkpoint in the shared folder, runs until the data
that is there at its start is used up (``availableNow``) and then stops, unless a trigger
interval is given. Sinks are files or versioned tables, never the driver's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from millrace.functions.records import message_id
from millrace.sources.store import KeyedTable

# A visit is over half an hour after its last action, or an hour after its first.
VISIT_TIMEOUT_SECONDS = 1800
VISIT_MAX_SECONDS = 3600

MESSAGE = "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"


# --- message logs -----------------------------------------------------------------------


def read_messages(spark: SparkSession, servers: str, topics: Sequence[str], start: str = "earliest") -> DataFrame:
    """A stream of messages from a broker; batch bounds are its offsets at the start of a run.

    A time as start: ``startingTimestamp`` in the reader's options.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    return reader.option("startingOffsets", start).load()


def stream_envelope(messages: DataFrame, process: Callable[[Column], Column] | None = None) -> DataFrame:
    """Messages with their origin in one nested column, an id, and the payload as it is or
    through a column expression."""
    data = F.col("value").cast("string")
    key = F.col("key").cast("string")
    return messages.select(
        F.struct(
            F.col("partition"),
            F.col("topic"),
            key.alias("key"),
            F.col("offset"),
            F.col("timestamp").alias("ts"),
            (data if process is None else process(data)).alias("data"),
        ).alias("message"),
        message_id(F.col("topic"), F.col("partition"), key, F.col("offset")).alias("message_id"),
    )


def stream_offsets_state(messages: DataFrame, unit: Sequence[str] = ("topic", "partition"), position: str = "offset") -> DataFrame:
    """The last position of every partition or shard.

    Sequence numbers that come as text compare as numbers: the longer one is larger, and they
    may have more digits than a decimal holds.
    """
    if isinstance(messages.schema[position].dataType, T.StringType):
        digits = F.ltrim(F.col(position), F.lit("0"))
        last = F.max(F.struct(F.length(digits).alias("n"), digits.alias("v")))["v"]
        return messages.groupBy(*unit).agg(F.coalesce(F.nullif(last, F.lit("")), F.lit("0")).alias("last_position"))
    return messages.groupBy(*unit).agg(F.max(position).alias("last_position"))


def unread(state: DataFrame, newest: DataFrame, unit: Sequence[str] = ("topic", "partition")) -> DataFrame:
    """Partitions with messages after the last one read, be it a single one."""
    have = state.withColumnRenamed("last_position", "_last")
    end = newest.withColumnRenamed("last_position", "_end")
    joined = end.join(have, list(unit), "left")
    return joined.select(*unit, (F.col("_end") - F.coalesce("_last", F.lit(-1))).alias("unread")).where("unread > 0")


def stream_dedup(messages: DataFrame, late: str = "1 hour", keys: Sequence[str] = ("topic", "partition", "offset"), ts: str = "timestamp") -> DataFrame:
    """Messages once each, also when a retry delivers them again within the watermark."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


# --- running a stream -------------------------------------------------------------------


def run(writer: DataStreamWriter, checkpoint: str, interval: str | None = None) -> None:
    """Start and wait: one bounded pass, or for ever at an interval."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    query = writer.start()
    query.awaitTermination()


def stream_bounded_read(messages: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> None:
    """Append all messages that exist now, one folder (table) per topic; the next run goes on
    after them."""
    run(messages.writeStream.format("parquet").partitionBy("topic").option("path", path).outputMode("append"), checkpoint, interval)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def upsert(
    path: str, keys: Sequence[str], partition: str, latest_by: Sequence[str], lag: tuple[str, str] | None = None
) -> Callable[[DataFrame, int], None]:
    """A batch function that merges into a keyed table at ``path``, cut by ``partition``.

    Replaying a batch after a failure leaves the same rows, since it merges by key; only the parts a batch touches are
    rewritten, and readers see whole versions. ``lag`` is a time column and an interval: rows older than the newest
    loaded one less the interval are left out. The newest time is committed with the rows it comes from. A batch is kept
    while it is merged, so its source is read once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                merge(batch, number)
        finally:
            batch.unpersist()

    def merge(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, path, keys, partition=partition)
        fresh, note = batch, {"batch": number}
        if lag is not None:
            micros = F.unix_micros(F.col(lag[0]).cast("timestamp"))
            known = table.note().get("newest")
            if known is not None:
                fresh = batch.where(F.col(lag[0]) >= F.timestamp_micros(F.lit(known)) - F.expr(f"INTERVAL {lag[1]}"))
            newest = fresh.agg(F.max(micros)).first()[0]
            note["newest"] = max((t for t in (known, newest) if t is not None), default=None)
        table.merge(fresh, latest_by, note)

    return apply


def merged(spark: SparkSession, path: str, keys: Sequence[str], partition: str) -> DataFrame:
    """What the batches have merged so far."""
    return KeyedTable(spark, path, keys, partition=partition).read()


def stream_files(
    files: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str, latest_by: Sequence[str], interval: str | None = None
) -> None:
    """Load files as they arrive and merge them by key. For files that still grow see ``arrivals``."""
    run(files.writeStream.foreachBatch(upsert(path, keys, partition, latest_by)), checkpoint, interval)


def lag_merge_stream(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], partition: str, ts: str, lag: str, interval: str | None = None
) -> None:
    """Upsert by key what is not older than the newest loaded row less a lag (``3 days``);
    later corrections win. ``partition`` grows with ``ts``, such as its day."""
    run(rows.writeStream.foreachBatch(upsert(path, keys, partition, [ts], (ts, lag))), checkpoint, interval)


def stream_metrics(
    rows: DataFrame, ts: str, keys: Sequence[Column], value: Column, window: str, late: str, path: str, checkpoint: str, interval: str | None = None
) -> None:
    """Metric values per key and time window as a stream, merged into the stored history.

    Update mode hands on windows that changed; the merge by (metric, window) keeps the last
    state, so a replayed batch changes nothing. ``keys`` are one column, the metric's name.
    """
    grouped = (
        rows.withWatermark(ts, late)
        .groupBy(keys[0].alias("metric_name"), F.window(ts, window).alias("w"))
        .agg(value.alias("metric_value"))
        .select("metric_name", "metric_value", F.col("w.start").alias("recorded_at"), F.date_format("w.start", "yyyy-MM").alias("month"))
    )
    # A window has one row per batch, so there is no order to choose by.
    batch = upsert(path, ["metric_name", "recorded_at"], "month", [])
    run(grouped.writeStream.outputMode("update").foreachBatch(batch), checkpoint, interval)


# --- visits -----------------------------------------------------------------------------


def sessions(events: DataFrame, keys: Sequence[str], ts: str, gap: str, *aggregates: Column) -> DataFrame:
    """Visits by gaps in time, in batch or as a stream (with a watermark on ``ts``).

    With the session of ``prepare`` they are merged within each task before the shuffle, so a user with a
    third of the events ships sessions, not events.
    """
    return (
        events.groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(F.min(ts).alias("first_action"), F.max(ts).alias("last_action"), *aggregates)
        .drop("_w")
    )


def stream_sessions(
    events: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str, path: str, checkpoint: str, *aggregates: Column, interval: str | None = None
) -> None:
    """Append every visit to ``path`` once, when it is over in event time.

    A visit is over when the newest event, less ``late``, is ``gap`` behind its last action; until then it is state of
    the stream, which later deliveries go on with. Events older than the watermark come too late and are left out.
    """
    visits = sessions(events.withWatermark(ts, late), keys, ts, gap, *aggregates)
    run(visits.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, interval)


def closed_sessions(
    visits: DataFrame,
    sites: Sequence[str],
    order: Sequence[str],
    now: Column,
    timeout: int = VISIT_TIMEOUT_SECONDS,
    longest: int = VISIT_MAX_SECONDS,
) -> DataFrame:
    """Visits that are over, of a list that is read newest first.

    Everything up to the oldest visit that still goes on is left for the next read. That visit
    is the smallest by ``order`` among the active ones of its site: an aggregate, not a ranking.
    """
    rows = visits.withColumn("_now", now)

    def since(column: str) -> Column:
        return (F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col(column).cast("timestamp"))) / 1e6

    active = (since("last_action") < timeout) & (since("first_action") < longest)
    place = F.struct(*[F.col(c) for c in order])
    cut = rows.groupBy(*sites).agg(F.min(F.when(active, place)).alias("_cut"))
    joined = rows.join(cut, list(sites))
    return joined.where(F.col("_cut").isNull() | (place < F.col("_cut"))).select(*visits.columns)
