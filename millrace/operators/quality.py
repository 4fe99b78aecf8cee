"""Data-quality tests, load checks of a table, and the payments figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import quoted
from millrace.operators.monitor import days, moment
from millrace.operators.profile import value_counts

# Column names that are tested for uniqueness.
UNIQUE_NAMES = ("id", "uuid", "key")
# Row counts below which a table scores very_low, low and good.
VERY_LOW, LOW, GOOD = 10, 100, 10_000
# A running record older than this failed; finished ones are kept this long.
STALE_RUNNING_HOURS = 24
RETENTION_DAYS = 30


# --- suggested and executed tests -------------------------------------------------------


def suggest_tests(
    profile: DataFrame, declared_not_null: Sequence[str] = (), configured: DataFrame | None = None
) -> DataFrame:
    """Tests (table_name, column_name, test) a profile speaks for.

    A test that is already ``configured`` for the column is not suggested again.
    """
    not_null = (F.col("null_pct") == 0.0) | F.col("column_name").isin(*declared_not_null)
    unique = F.lower("column_name").isin(*UNIQUE_NAMES)
    tests = F.array_compact(F.array(F.when(not_null, F.lit("not_null")), F.when(unique, F.lit("unique"))))
    out = profile.select("table_name", "column_name", F.explode(tests).alias("test")).distinct()
    if configured is None:
        return out
    return out.join(configured.select("table_name", "column_name", "test").distinct(), ["table_name", "column_name", "test"], "left_anti")


def _verdict(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("failures") > 0, "fail").otherwise("pass"))


def dq_not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, all columns in one aggregation."""
    wide = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(f"f{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("failures")) for i, c in enumerate(columns)])
    out = wide.select(F.inline(rows))
    return _verdict(out.select(F.lit(table).alias("table_name"), "column_name", F.lit("not_null").alias("test"), "failures"))


def dq_unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once, per column (NULL is not a value)."""
    counted = value_counts(df, [df.schema[c] for c in columns])
    failures = counted.groupBy("column_name").agg(F.count_if(F.col("n") > 1).alias("failures"))
    # A column without any value has no failures but still a result.
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    out = named.join(failures, "column_name", "left").select(
        F.lit(table).alias("table_name"),
        "column_name",
        F.lit("unique").alias("test"),
        F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"),
    )
    return _verdict(out)


def dq_accepted_values(df: DataFrame, table: str, accepted: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose value is outside the accepted ones (NULL passes), all columns in one aggregation."""
    items = list(accepted.items())
    wide = df.agg(*[F.count_if(~F.col(quoted(c)).isin(*values)).alias(f"f{i}") for i, (c, values) in enumerate(items)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("failures")) for i, (c, _) in enumerate(items)])
    out = wide.select(F.inline(rows))
    return _verdict(out.select(F.lit(table).alias("table_name"), "column_name", F.lit("accepted_values").alias("test"), "failures"))


def dq_report(results: DataFrame) -> DataFrame:
    """Counts of pass, warn and fail per table; ``success`` is a pass, ``error`` a fail."""
    s = F.col("status")
    return results.groupBy("table_name").agg(
        F.count_if(s.isin("pass", "success")).alias("passed"),
        F.count_if(s == "warn").alias("warned"),
        F.count_if(s.isin("fail", "error")).alias("failed"),
        F.count(F.lit(1)).alias("tests"),
    )


# --- checks of a loaded table -----------------------------------------------------------

CURSOR_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegerType, T.LongType, T.StringType)

CURSOR_SCHEMA = "cursor string, column_exists boolean, data_type string, null_count bigint, sample_values array<string>, issues array<string>, valid boolean"


def cursor_validation(df: DataFrame, cursor: str) -> DataFrame:
    """Whether a column can drive incremental loads: it exists, has a fit type and no NULLs.

    One row, with the five largest values as a sample (a top-k, not a sort). The wording of the issues is a fixed value.
    """
    found = [f for f in df.schema.fields if f.name == cursor]
    if not found:
        missing = (cursor, False, None, None, [], [f"Cursor field '{cursor}' not found in table"], False)
        return df.sparkSession.createDataFrame([missing], CURSOR_SCHEMA)
    dtype = found[0].dataType
    col = F.col(quoted(cursor))
    top = (
        df.select(col.alias("v"))
        .where(F.col("v").isNotNull())
        .orderBy(F.desc("v"))
        .limit(5)
        .agg(F.transform(F.sort_array(F.collect_list("v"), asc=False), lambda v: v.cast("string")).alias("sample"))
    )
    fit = isinstance(dtype, CURSOR_TYPES)
    issues = F.array_compact(
        F.array(
            F.lit(None if fit else f"Cursor field has unexpected type '{dtype.simpleString()}'").cast("string"),
            F.when(F.col("nulls") > 0, F.concat(F.col("nulls").cast("string"), F.lit(" NULL values found in cursor field"))),
        )
    )
    return (
        df.agg(F.count_if(col.isNull()).alias("nulls"))
        .select(
            F.lit(cursor).alias("cursor"),
            F.lit(True).alias("column_exists"),
            F.lit(dtype.simpleString()).alias("data_type"),
            F.col("nulls").alias("null_count"),
            F.coalesce(top.scalar(), F.array().cast("array<string>")).alias("sample_values"),
            issues.alias("issues"),
        )
        .withColumn("valid", F.size("issues") == 0)
    )


def schema_diff(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Columns (table_name, column_name) added to or removed from the expected ones."""
    keys = ["table_name", "column_name"]
    a, b = current.select(*keys).distinct(), expected.select(*keys).distinct()
    added = a.join(b, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(b.join(a, keys, "left_anti").withColumn("change", F.lit("removed")))


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns and types of tables as rows (as many as there are columns)."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


def completeness(df: DataFrame, table: str, loaded_at: str | None = None) -> DataFrame:
    """Row count, whether there is data, the last load time, and a score."""
    last = F.max(quoted(loaded_at)) if loaded_at else F.lit(None).cast("timestamp_ntz")
    n = F.col("row_count")
    score = F.when(n == 0, "empty").when(n < VERY_LOW, "very_low").when(n < LOW, "low").when(n < GOOD, "good").otherwise("excellent")
    return df.agg(F.count(F.lit(1)).alias("row_count"), last.alias("last_loaded")).select(
        F.lit(table).alias("table_name"), "row_count", (n > 0).alias("has_data"), "last_loaded", score.alias("health_score")
    )


def row_counts_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table; parquet answers from the file footers."""
    out = None
    for name in sorted(tables):
        part = tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no tables given")
    return out


def source_summary(counts: DataFrame, owners: DataFrame) -> DataFrame:
    """Tables and rows per source, from counts per table and the (table_name, source) list."""
    return (
        owners.join(counts, "table_name", "left")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("table_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"))
    )


# --- payments figures -------------------------------------------------------------------


def mrr(subscriptions: DataFrame, now: datetime | Column) -> DataFrame:
    """Monthly recurring revenue of subscriptions that are being paid, created before next month."""
    share = F.when(F.col("discount__coupon__duration") == "forever", F.col("discount__coupon__percent_off")).otherwise(F.lit(0.0))
    amount = F.col("plan__amount") * F.col("quantity") * (1 - share / 100) / 100
    monthly = F.when(F.col("plan__interval") == "month", amount).when(F.col("plan__interval") == "year", amount / 12)
    next_month = F.add_months(F.trunc(moment(now).cast("date"), "month"), 1)
    counted = subscriptions.where(F.col("created") < next_month).where(F.col("status").isin("active", "past_due"))
    return counted.agg(F.round(F.coalesce(F.sum(monthly), F.lit(0.0)), 2).alias("mrr"))


def churn_rate(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Share of deleted subscriptions in deleted and not cancelled ones."""
    deleted = events.agg(F.count_if(F.col("type") == "customer.subscription.deleted").alias("n"))
    alive = subscriptions.agg(F.count_if(F.col("status") != "canceled").alias("alive"))
    return (
        alive.withColumn("deleted", deleted.scalar())
        .select(F.round(F.try_divide(F.col("deleted").cast("double"), F.col("deleted") + F.col("alive")), 3).alias("churn_rate"))
    )


def conditional_ratio(condition: Column) -> Column:
    """Percentage of rows that meet a condition; NULL for no rows."""
    return F.try_divide(F.count_if(condition) * F.lit(100.0).cast("double"), F.count(F.lit(1)))


# --- run history ------------------------------------------------------------------------


def avg_run_duration(runs: DataFrame, now: datetime | Column, n_days: int = 7) -> DataFrame:
    """Mean duration of the successful runs of the last days, per schedule."""
    recent = runs.where(F.col("started_at") >= moment(now) - days(n_days))
    return (
        recent.where((F.col("status") == "success") & F.col("duration_seconds").isNotNull())
        .groupBy("schedule_name")
        .agg(F.avg("duration_seconds").alias("avg_duration"))
    )


def retention_purge(runs: DataFrame, now: datetime | Column, keep_days: int = RETENTION_DAYS, stale_hours: int = STALE_RUNNING_HOURS) -> DataFrame:
    """The run history to keep: running rows that went stale become failed, old finished rows go.

    Stale rows are marked first, so one older than the retention goes as well.
    """
    stale = (F.col("status") == "running") & (F.col("started_at") < moment(now) - F.make_dt_interval(hours=F.lit(stale_hours)))
    marked = runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
    return marked.where((F.col("started_at") >= moment(now) - days(keep_days)) | (F.col("status") == "running"))
