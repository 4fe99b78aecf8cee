"""Write dispositions, guards of a load, and which rows an incremental load reads."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.casts import to_long
from millrace.functions.names import first_line, quoted
from millrace.operators.dedup import first_row
from millrace.operators.monitor import days, moment
from millrace.operators.timeline import neighbour

# Bounds of the row-count check and the runs it looks back on.
ANOMALY_LOW, ANOMALY_HIGH, ANOMALY_RUNS = 0.5, 3.0, 5
# Fixed value: months a source keeps reporting data for.
RETENTION_MONTHS = 37
# Days per unit of a backfill duration.
DURATION_DAYS = {"d": 1, "w": 7, "m": 30}


# --- dispositions -----------------------------------------------------------------------


def write_append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch, allowMissingColumns=True)


def write_merge(target: DataFrame, batch: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """Upsert: rows of the batch replace those of the same key.

    The batch is reduced to one row per key first (the latest), which also bounds what the
    anti join sees of a key repeated in it. Keys compare NULL-safe.
    """
    order = [F.col(quoted(c)).desc_nulls_last() for c in latest_by]
    fresh = first_row(batch, keys, order)
    return without_keys(target, fresh, keys).unionByName(fresh, allowMissingColumns=True)


def without_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` whose key is not in ``batch``, NULL being a key like any other."""
    t, b = target.alias("t"), batch.select(*[quoted(k) for k in keys]).alias("b")
    same = [F.col(f"t.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) for k in keys]
    return t.join(b, same, "left_anti")


def write_delete_insert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge on a key that is not unique: all rows of the batch's keys go, the batch comes."""
    gone = batch.select(*[quoted(k) for k in keys]).distinct()
    return without_keys(target, gone, keys).unionByName(batch, allowMissingColumns=True)


# --- guards -----------------------------------------------------------------------------


def empty_replace_guard(counts: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Decide per table whether a staged version may replace the live one.

    ``counts``: table_name, live_rows, staged_rows. No rows over some rows is refused.
    """
    refused = (F.col("staged_rows") == 0) & (F.col("live_rows") > 0) & F.lit(not allow_empty)
    return counts.withColumn("action", F.when(refused, "keep_old").otherwise("swap"))


def count_versions(live: Mapping[str, DataFrame], staged: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts (table_name, live_rows, staged_rows) of two sets of tables."""
    out = None
    for name in sorted(set(live) | set(staged)):
        parts = {
            "live_rows": live.get(name),
            "staged_rows": staged.get(name),
        }
        one = None
        for column, df in parts.items():
            if df is None:
                continue
            count = df.agg(F.count(F.lit(1)).alias(column))
            one = count if one is None else one.withColumn(column, count.scalar())
        row = one.select(
            F.lit(name).alias("table_name"),
            *[(F.col(c) if parts[c] is not None else F.lit(0).cast("bigint")).alias(c) for c in parts],
        )
        out = row if out is None else out.unionByName(row)
    return out


def table_truncation_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables (table_name, row_count) that had rows before and have none after."""
    b = before.select("table_name", F.col("row_count").alias("rows_before"))
    a = after.select("table_name", F.col("row_count").alias("rows_after"))
    return (
        b.join(a, "table_name", "full")
        .na.fill(0, ["rows_before", "rows_after"])
        .where((F.col("rows_before") > 0) & (F.col("rows_after") == 0))
        .select("table_name", "rows_before")
    )


def previous_total(history: DataFrame, runs: int = ANOMALY_RUNS) -> DataFrame:
    """Total of the newest success with a count among the last runs of each source."""
    order = Window.partitionBy("source").orderBy(F.desc("timestamp"))
    last = history.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= runs)
    total = F.when(F.col("total_row_count") > 0, F.col("total_row_count")).when(F.col("rows_processed") > 0, F.col("rows_processed"))
    counted = F.when((F.col("status") == "success") & total.isNotNull(), F.col("_n"))
    return last.groupBy("source").agg(F.min_by(total, counted).alias("previous_rows")).where("previous_rows IS NOT NULL")


def row_count_anomaly(totals: DataFrame, history: DataFrame) -> DataFrame:
    """Judge the total rows (source, total_rows) of each source against its previous success."""
    ratio = F.col("total_rows") / F.col("previous_rows")
    level = F.when(F.col("total_rows") == 0, "error").when((ratio < ANOMALY_LOW) | (ratio > ANOMALY_HIGH), "warning")
    return totals.join(previous_total(history), "source").withColumn("level", F.coalesce(level, F.lit("none")))


def data_loss_check(history: DataFrame) -> DataFrame:
    """Full refreshes that loaded fewer rows than the run before them."""
    return (
        neighbour(history, ["source"], "timestamp", {"total_row_count": "rows_before"})
        .where(F.col("full_refresh") & (F.col("total_row_count") < F.col("rows_before")))
        .select("source", "timestamp", "rows_before", F.col("total_row_count").alias("rows_after"))
    )


def load_row_counts(tables: Mapping[str, DataFrame], load_column: str, load_id) -> DataFrame:
    """Rows per table loaded by one run and in total, with a line for the whole source."""
    out = None
    for name in sorted(tables):
        part = tables[name].agg(
            F.count_if(F.col(quoted(load_column)) == load_id).alias("rows_loaded"), F.count(F.lit(1)).alias("total_rows")
        )
        part = part.select(F.lit(name).alias("table_name"), "rows_loaded", "total_rows")
        out = part if out is None else out.unionByName(part)
    whole = out.agg(F.sum("rows_loaded").alias("rows_loaded"), F.sum("total_rows").alias("total_rows"))
    return out.unionByName(whole.select(F.lit("__total__").alias("table_name"), "rows_loaded", "total_rows"))


def partial_load(spark: SparkSession, loads: Mapping[str, Callable[[], DataFrame]], write: Callable[[str, DataFrame], None]) -> DataFrame:
    """Load each table on its own: one that fails is reported and the rest is loaded."""
    rows = []
    for name, read in loads.items():
        try:
            write(name, read())
            rows.append((name, "loaded", None))
        except Exception as error:  # noqa: BLE001 - whatever one table raises must not stop the others
            rows.append((name, "failed", first_line(error)))
    failed = sum(r[1] == "failed" for r in rows)
    overall = "success" if failed == 0 else "failed" if failed == len(rows) else "partial"
    return spark.createDataFrame([(*r, overall) for r in rows], "table_name string, status string, error string, load_status string")


def empty_with_schema(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A typed table without rows, for an endpoint that returned none."""
    return spark.createDataFrame([], schema)


# Declared kinds of columns and their types.
HINT_TYPES = {"bigint": "bigint", "bool": "boolean", "double": "double", "text": "string", "complex": "string", "timestamp": "timestamp", "date": "date"}


def hinted_schema(hints: Mapping[str, str]) -> str:
    """Declared column kinds as a schema; nested values are kept as JSON text."""
    return ", ".join(f"{quoted(name)} {HINT_TYPES[kind]}" for name, kind in hints.items())


# --- which rows to read -----------------------------------------------------------------


def incremental_cursor(
    df: DataFrame, cursor: str, last_value=None, end_value=None, direction: str = "max"
) -> tuple[DataFrame, DataFrame]:
    """Rows from the last cursor value on (it is read again) and the new state.

    The comparison is on the bare column, so it reaches the source. With ``direction`` min
    the cursor runs backwards.
    """
    if direction not in ("max", "min"):
        raise ValueError("direction is max or min")
    col = F.col(quoted(cursor))
    rows = df
    if last_value is not None:
        rows = rows.where(col >= last_value if direction == "max" else col <= last_value)
    if end_value is not None:
        rows = rows.where(col < end_value if direction == "max" else col > end_value)
    best = F.max(col) if direction == "max" else F.min(col)
    state = rows.agg(F.coalesce(best, F.lit(last_value)).alias("last_value") if last_value is not None else best.alias("last_value"))
    return rows, state


def cursor_alternatives(columns: Sequence[str]) -> Column:
    """The first of several cursor columns that is set."""
    return F.coalesce(*[F.col(quoted(c)) for c in columns])


def archive_skip(archives: DataFrame, loaded: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Monthly archives (``month`` as yyyy/MM) still to load, within [start, end]."""
    rows = archives
    if start is not None:
        rows = rows.where(F.col("month") >= start)
    if end is not None:
        rows = rows.where(F.col("month") <= end)
    keys = [c for c in loaded.columns if c in archives.columns]
    return rows.join(loaded.select(*keys).distinct(), keys, "left_anti")


def incremental_lag(target: DataFrame, source: DataFrame, keys: Sequence[str], cursor: str, lag_days: int) -> DataFrame:
    """Read the source again from the target's newest cursor less a lag, and merge by key.

    Late corrections inside the lag window replace what was loaded. The start is looked up first, so
    the scan of the source filters by a plain value.
    """
    start = target.agg((F.max(quoted(cursor)) - days(lag_days)).alias("s")).first()["s"]
    again = source if start is None else source.where(F.col(quoted(cursor)) >= F.lit(start))
    return write_merge(target, again, keys, [cursor])


def clamp_start(cursor: Column, lag_days: int, now: datetime | Column, months: int = RETENTION_MONTHS) -> Column:
    """Start of a report: the cursor less its lag, not before what the source still keeps."""
    oldest = F.add_months(moment(now).cast("date"), -months)
    return F.greatest(F.coalesce(F.date_sub(cursor.cast("date"), lag_days), oldest), oldest)


def date_range_filter(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows created in [start, end)."""
    col = F.col(quoted(column))
    rows = df if start is None else df.where(col >= start)
    return rows if end is None else rows.where(col < end)


def duration_days(text: str) -> int:
    """Days of a duration such as 7d, 2w or 1m (a month is 30 days)."""
    match = re.fullmatch(r"(\d+)([dwmDWM])", text)
    if not match or int(match.group(1)) <= 0:
        raise ValueError(f"{text!r} is not a duration like 7d, 2w or 1m")
    return int(match.group(1)) * DURATION_DAYS[match.group(2).lower()]


def backfill_days(text: Column) -> Column:
    """The same for a column of durations; NULL for what is not one."""
    n = to_long(F.regexp_extract(text, r"^(\d+)([dwmDWM])$", 1)).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"^(\d+)([dwmDWM])$", 2))
    table = F.create_map(*[F.lit(v) for pair in DURATION_DAYS.items() for v in pair])
    return F.when(n > 0, n * F.try_element_at(table, unit))


def backfill_window(df: DataFrame, column: str, duration: str, now: datetime | Column, since: date | None = None, until: date | None = None) -> DataFrame:
    """Rows from now less a duration on; a duration excludes explicit bounds."""
    if since is not None or until is not None:
        raise ValueError("a backfill duration cannot be combined with since or until")
    return df.where(F.col(quoted(column)) >= moment(now) - days(duration_days(duration)))


def gap_fill(requests: DataFrame, history: DataFrame) -> DataFrame:
    """The range to load before what successful runs started at, for a request that begins earlier.

    ``requests``: source, start_date. ``history``: source, status, start_date.
    """
    earliest = (
        history.where((F.col("status") == "success") & F.col("start_date").isNotNull())
        .groupBy("source")
        .agg(F.min("start_date").alias("gap_end"))
    )
    return (
        requests.join(earliest, "source")
        .where(F.col("start_date") < F.col("gap_end"))
        .select("source", F.col("start_date").alias("gap_start"), "gap_end")
    )


def route_name(*parts: Column) -> Column:
    """The table a row belongs to, named from its values."""
    return F.regexp_replace(F.lower(F.concat_ws("_", *parts)), "[^a-z0-9]+", "_")


def route_by_key(df: DataFrame, route: Column, path: str) -> None:
    """Write every row to the folder of its route."""
    clustered(df.withColumn("route", route), "route").write.partitionBy("route").mode("append").parquet(path)


def clustered(df: DataFrame, partition: str) -> DataFrame:
    """Rows brought together by partition before a partitioned write.

    Without it every task writes a file to every partition. Adaptive execution merges small
    partitions and splits one that is too large over several tasks.
    """
    return df.hint("rebalance", F.col(quoted(partition)))


def scan_pushdown(
    df: DataFrame, keys: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Only the wanted columns, the key always among them, and at most ``limit`` rows."""
    if include and exclude:
        raise ValueError("give columns to include or to exclude, not both")
    if include:
        kept = [c for c in df.columns if c in include or c in keys]
    else:
        kept = [c for c in df.columns if c not in exclude or c in keys]
    out = df.select(*[quoted(c) for c in kept])
    return out if limit is None else out.limit(limit)
