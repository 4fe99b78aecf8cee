"""Business metrics: evaluation, baselines, trends, forecasts and status.

History is one table for all metrics, ``(metric_name, source, table_name, metric_value,
recorded_at)``, and every function works on all metrics of it at once. "Now" is always an
argument (a timestamp or a column), never the clock.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.names import first_line, normalize_name

# Comparison kinds and limits that results depend on.
COMPARISONS = (
    "none",
    "week_over_week",
    "rolling_7day_avg",
    "rolling_30day_avg",
    "prior_period",
)
TREND_MIN_POINTS = 14
TREND_MAX_POINTS = 30
TREND_SHARE_OF_MEAN = 0.01
FORECAST_MAX_DAYS = 365

STATUS_ORDER = ("flagged", "trending", "normal", "error")

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("metric_name", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("recorded_at", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class Monitor:
    """One metric: an aggregate expression over a ``source.table``, and how to judge it."""

    name: str
    table: str
    value: str
    filter: str | None = None
    compare: str = "none"
    alert_threshold: float | None = None
    drill_down: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", self.name):
            raise ValueError(f"metric name {self.name!r} is not a plain identifier")
        if "." not in self.table:
            raise ValueError(f"table {self.table!r} must be written source.table")
        if self.compare not in COMPARISONS:
            raise ValueError(f"unknown comparison {self.compare!r}")
        if self.alert_threshold is not None and self.alert_threshold <= 0:
            raise ValueError("alert_threshold must be above 0")

    @property
    def source(self) -> str:
        schema = self.table.split(".", 1)[0]
        return schema.removeprefix("raw_")

    @property
    def table_name(self) -> str:
        return self.table.split(".", 1)[1]


def moment(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def settings(spark: SparkSession, monitors: Iterable[Monitor]) -> DataFrame:
    """The judging part of the monitors as a table (as long as the configuration)."""
    rows = [
        (m.name, m.source, m.table_name, m.compare, None if m.alert_threshold is None else float(m.alert_threshold))
        for m in monitors
    ]
    return spark.createDataFrame(
        rows,
        "metric_name string, source string, table_name string, comparison_type string, alert_threshold double",
    )


# --- evaluation -------------------------------------------------------------------------


def _valid(table: DataFrame, monitor: Monitor) -> str | None:
    """The analyser's complaint about one monitor, or None."""
    try:
        base = table if monitor.filter is None else table.where(monitor.filter)
        base.agg(F.expr(monitor.value)).schema  # noqa: B018 - analysis only, no job
    except (AnalysisException, ParseException) as error:
        return first_line(error)
    return None


def _values(table: DataFrame, members: Sequence[Monitor]) -> DataFrame:
    """(place in ``members``, value) of monitors, a plain aggregate for each distinct filter.

    Monitors with the same filter share a scan that the filter is pushed into; an expression sees the rows of its own
    filter only, and an aggregate without rows still gives its value.
    """
    parts = []
    for condition in dict.fromkeys(m.filter for m in members):
        own = [(i, m) for i, m in enumerate(members) if m.filter == condition]
        base = table if condition is None else table.where(condition)
        found = base.agg(*[F.expr(m.value).try_cast("double").alias(f"v{i}") for i, m in own])
        parts.append(found.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value")) for i, _ in own]))))
    return reduce(DataFrame.unionByName, parts)


def _evaluated(table: DataFrame, members: Sequence[Monitor]) -> list[tuple[Monitor, float | None, str | None]]:
    """Value or error of every monitor. Members of a failing evaluation are halved until those that fail stand alone."""
    try:
        found = {row["i"]: row["value"] for row in _values(table, members).collect()}
    except (PySparkException, Py4JJavaError) as error:
        if len(members) == 1:
            return [(members[0], None, first_line(error))]
        half = len(members) // 2
        return _evaluated(table, members[:half]) + _evaluated(table, members[half:])
    return [(m, found[i], None) for i, m in enumerate(members)]


def metric_eval(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    monitors: Sequence[Monitor],
    now: datetime | Column,
) -> DataFrame:
    """Current value of every monitor, evaluated now; the result is as long as the configuration.

    A monitor that cannot be analysed or that fails on its rows becomes a row with ``error``, and the others keep
    their values.
    """
    groups: dict[str, list[Monitor]] = {}
    rows: list[tuple[Monitor, float | None, str | None]] = []
    for m in monitors:
        if m.table not in tables:
            rows.append((m, None, f"table {m.table} does not exist"))
            continue
        complaint = _valid(tables[m.table], m)
        if complaint:
            rows.append((m, None, complaint))
        else:
            groups.setdefault(m.table, []).append(m)
    for table, members in groups.items():
        rows += _evaluated(tables[table], members)
    out = spark.createDataFrame(
        [(m.name, m.source, m.table_name, value, error) for m, value, error in rows],
        "metric_name string, source string, table_name string, metric_value double, error string",
    )
    return out.withColumn("recorded_at", moment(now))


def metric_series(df: DataFrame, ts: str, monitor_key: Column, value: Column, source: str, table: str) -> DataFrame:
    """Daily history of a metric family: one point per key and day of ``ts``."""
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    return (
        df.groupBy(monitor_key.alias("metric_name"), day.alias("recorded_at"))
        .agg(value.alias("metric_value"))
        .select(
            "metric_name",
            F.lit(source).alias("source"),
            F.lit(table).alias("table_name"),
            "metric_value",
            "recorded_at",
        )
    )


# --- ready-made monitors ----------------------------------------------------------------


def payments_monitors(source: str) -> list[Monitor]:
    """Revenue, new customers, refund rate and order value of a payments source."""
    # Expressions, comparisons and thresholds of the payments presets.
    charge, customer = f"raw_{source}.charge", f"raw_{source}.customer"
    paid = "status = 'succeeded'"
    return [
        Monitor(f"{source}_daily_revenue", charge, "SUM(amount) / 100.0", paid, "week_over_week", 20.0, ("currency",)),
        Monitor(f"{source}_new_customers", customer, "COUNT(*)", None, "week_over_week", 25.0),
        Monitor(
            f"{source}_refund_rate",
            charge,
            "COUNT(CASE WHEN refunded THEN 1 END) * 100.0 / NULLIF(COUNT(*), 0)",
            None,
            "rolling_7day_avg",
            50.0,
        ),
        Monitor(f"{source}_avg_order_value", charge, "AVG(amount) / 100.0", paid, "rolling_7day_avg", 15.0),
    ]


def traffic_monitors(source: str, columns: Sequence[str], table: str = "traffic") -> list[Monitor]:
    """Sessions, bounce rate and duration, for those whose column exists."""
    # Fixed values: (word in the column name, word that rules it out, metric, aggregate, comparison, threshold).
    wanted = (
        ("sessions", "engaged", "daily_sessions", "SUM", "week_over_week", 20.0),
        ("bounce_rate", None, "bounce_rate", "AVG", "rolling_7day_avg", 25.0),
        ("duration", None, "avg_session_duration", "AVG", "rolling_7day_avg", 20.0),
    )
    origin = [c for c in columns if "source" in c.lower()][:1]
    out = []
    for word, barred, name, aggregate, comparison, threshold in wanted:
        found = [c for c in columns if word in c.lower() and not (barred and barred in c.lower())]
        if found:
            dims = tuple(origin) if aggregate == "SUM" else ()
            out.append(
                Monitor(f"{source}_{name}", f"raw_{source}.{table}", f"{aggregate}(`{found[0]}`)", None, comparison, threshold, dims)
            )
    return out


def row_count_monitors(source: str, tables: Iterable[str]) -> list[Monitor]:
    """A row count per table of a source without presets."""
    out = []
    for table in sorted(tables):
        out.append(Monitor(f"{source}_{normalize_name(table) or 'table'}_row_count", f"raw_{source}.{table}", "COUNT(*)", None, "week_over_week", 25.0))
    return out


# --- baselines --------------------------------------------------------------------------


def baselines(history: DataFrame, now: datetime | Column) -> DataFrame:
    """Every time-based baseline per metric, in one aggregation with map-side combine.

    The history includes the current value, so a first run compares with itself.
    """
    value, at = F.col("metric_value"), F.col("recorded_at")
    known = value.isNotNull()
    rows = history.withColumn("_now", moment(now))
    week_ago = F.col("_now") - days(7)
    gap = F.abs(micros(at) - micros(week_ago))
    return rows.groupBy("metric_name").agg(
        F.max_by(value, F.struct(at, value)).alias("current_value"),
        F.min_by(value, F.when(known, F.struct(gap, at, value))).alias("week_over_week"),
        F.avg(F.when(at >= week_ago, value)).alias("rolling_7day_avg"),
        F.avg(F.when(at >= F.col("_now") - days(30), value)).alias("rolling_30day_avg"),
    )


def baseline_wow(history: DataFrame, now: datetime | Column) -> DataFrame:
    """The value nearest to seven days before now."""
    return baselines(history, now).select("metric_name", F.col("week_over_week").alias("baseline_value"))


def baseline_rolling(history: DataFrame, now: datetime | Column, n_days: int) -> DataFrame:
    """The mean of the last ``n_days`` days."""
    start = moment(now) - days(n_days)
    return (
        history.withColumn("_start", start)
        .groupBy("metric_name")
        .agg(F.avg(F.when(F.col("recorded_at") >= F.col("_start"), F.col("metric_value"))).alias("baseline_value"))
    )


def newest(history: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` known values per metric, ``nth`` = 1 for the newest.

    The bound on row_number reaches the map side, so a metric with a long history ships ``n`` rows per task.
    """
    order = Window.partitionBy("metric_name").orderBy(F.desc("recorded_at"), F.desc("metric_value"))
    known = history.where(F.col("metric_value").isNotNull())
    return known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def baseline_prior(history: DataFrame) -> DataFrame:
    """The second newest value."""
    return (
        newest(history, 2)
        .groupBy("metric_name")
        .agg(F.max(F.when(F.col("nth") == 2, F.col("metric_value"))).alias("baseline_value"))
    )


def change_pct(current: Column, base: Column) -> Column:
    """Percentage change, NULL without a baseline or for a baseline of 0."""
    return F.try_divide(current - base, F.abs(base)) * 100


def threshold_flag(change: Column, threshold: Column) -> Column:
    return F.coalesce(F.abs(change) >= threshold, F.lit(False))


# --- trend and forecast -----------------------------------------------------------------


def trend(history: DataFrame) -> DataFrame:
    """Least-squares slope over the newest 30 points, its direction, and the prior value."""
    value, nth = F.col("metric_value"), F.col("nth")
    points = (
        newest(history, TREND_MAX_POINTS)
        .groupBy("metric_name")
        .agg(
            F.count(F.lit(1)).alias("points"),
            # Counting backwards from the newest gives the same slope as counting up from the oldest.
            F.coalesce(F.regr_slope(value, -nth), F.lit(0.0)).alias("_slope"),
            F.avg(value).alias("_mean"),
            F.max(F.when(nth == 1, value)).alias("last_value"),
            F.max(F.when(nth == 2, value)).alias("prior_value"),
        )
    )
    enough = F.col("points") >= TREND_MIN_POINTS
    level = F.abs(F.col("_mean") * TREND_SHARE_OF_MEAN)
    direction = (
        F.when(F.col("_slope") > level, "increasing").when(F.col("_slope") < -level, "decreasing").otherwise("stable")
    )
    return points.select(
        "metric_name",
        "points",
        F.when(enough, F.col("_slope")).alias("trend_slope"),
        F.when(enough, F.col("_mean")).alias("trend_mean"),
        F.when(enough, direction).alias("trend_direction"),
        "last_value",
        "prior_value",
    )


def forecast_days(last: Column, slope: Column, threshold: Column, mean: Column) -> Column:
    """Whole days until the threshold is crossed at the present slope; 0 when it already is."""
    left = F.abs(mean * threshold / 100) - F.abs(last - mean)
    whole = F.floor(F.try_divide(left, F.abs(slope)))
    capped = F.least(whole, F.lit(FORECAST_MAX_DAYS)).cast("int")
    known = threshold.isNotNull() & slope.isNotNull() & (slope != 0) & (mean != 0)
    return F.when(known & (left <= 0), F.lit(0)).when(known & (whole > 0), capped)


# --- the whole comparison ---------------------------------------------------------------


def monitor_compare(history: DataFrame, judged: DataFrame, now: datetime | Column) -> DataFrame:
    """Baseline, change, flag, trend and forecast of every metric in ``judged`` (see ``settings``)."""
    facts = (
        judged.where(F.col("comparison_type") != "none")
        .join(baselines(history, now), "metric_name", "left")
        .join(trend(history), "metric_name", "left")
    )
    kind = F.col("comparison_type")
    base = F.col("prior_value")
    for name in ("week_over_week", "rolling_7day_avg", "rolling_30day_avg"):
        base = F.when(kind == name, F.col(name)).otherwise(base)
    has_value = F.col("current_value").isNotNull()
    return (
        facts.withColumn("baseline_value", F.when(has_value, base))
        .withColumn("change_pct", change_pct(F.col("current_value"), F.col("baseline_value")))
        .withColumn("exceeds_threshold", threshold_flag(F.col("change_pct"), F.col("alert_threshold")))
        .select(
            "metric_name",
            "comparison_type",
            "alert_threshold",
            "current_value",
            "baseline_value",
            "change_pct",
            "exceeds_threshold",
            F.when(has_value, F.col("trend_slope")).alias("trend_slope"),
            F.when(has_value, F.col("trend_direction")).alias("trend_direction"),
            F.when(
                has_value,
                forecast_days(F.col("last_value"), F.col("trend_slope"), F.col("alert_threshold"), F.col("trend_mean")),
            ).alias("forecast_threshold_days"),
        )
    )


def status(error: Column, exceeds: Column, direction: Column) -> Column:
    return (
        F.when(error.isNotNull(), "error")
        .when(exceeds, "flagged")
        .when(direction != "stable", "trending")
        .otherwise("normal")
    )


def monitor_categorize(values: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Current values with their comparison and status, most urgent first.

    ``values``: metric_name, source, table_name, metric_value, error.
    """
    joined = values.join(comparisons, "metric_name", "left").select(
        F.col("metric_name").alias("name"),
        status(F.col("error"), F.col("exceeds_threshold"), F.col("trend_direction")).alias("status"),
        F.col("metric_value").alias("value"),
        "change_pct",
        "comparison_type",
        "baseline_value",
        F.coalesce("exceeds_threshold", F.lit(False)).alias("exceeds_threshold"),
        "trend_direction",
        "forecast_threshold_days",
        "source",
        "table_name",
        "error",
    )
    return joined.orderBy(*urgency())


def urgency() -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return [rank, F.coalesce(F.abs("change_pct"), F.lit(0.0)).desc(), F.col("name")]


def monitor_summary(results: DataFrame) -> DataFrame:
    """One line of text (its wording is a fixed value): up to three flagged metrics, the count of trending ones, the total."""
    flagged = F.col("exceeds_threshold")
    trending = (F.col("trend_direction") != "stable") & ~flagged
    label = F.when(F.col("change_pct").isNull(), F.col("name")).otherwise(
        F.concat(
            F.col("name"),
            F.lit(" "),
            F.when(F.col("change_pct") > 0, "+").otherwise(""),
            F.format_string("%.1f%%", F.col("change_pct")),
        )
    )
    counts = results.agg(
        F.count_if(flagged).alias("n_flagged"), F.count_if(trending).alias("n_trending"), F.count(F.lit(1)).alias("n")
    )
    # Three rows at most, chosen by a distributed top-k before they are put in one line.
    top = (
        results.where(flagged)
        .select(F.coalesce(F.abs("change_pct"), F.lit(0.0)).alias("size"), F.col("name"), label.alias("label"))
        .orderBy(F.desc("size"), "name")
        .limit(3)
        .agg(F.array_sort(F.collect_list(F.struct(-F.col("size"), "name", "label"))).alias("top"))
    )
    names = F.concat_ws(", ", F.transform("top", lambda t: t["label"]))
    parts = F.concat_ws(
        ", ",
        F.when(F.col("n_flagged") > 0, F.concat(F.col("n_flagged").cast("string"), F.lit(" flagged ("), names, F.lit(")"))),
        F.when(F.col("n_trending") > 0, F.concat(F.col("n_trending").cast("string"), F.lit(" trending"))),
    )
    line = F.concat(F.when(parts == "", "No issues").otherwise(parts), F.lit(". "), F.col("n").cast("string"), F.lit(" total."))
    return counts.withColumn("top", top.scalar()).select(line.alias("summary"))


# --- stored results ---------------------------------------------------------------------


def metric_latest(history: DataFrame, results: DataFrame) -> DataFrame:
    """Newest value per metric with its newest comparison (ties of the newest value are kept).

    Only comparison kinds count: drill-down snapshots in the same table are left out.
    """
    by_time = Window.partitionBy("metric_name")
    value = (
        history.withColumn("_r", F.rank().over(by_time.orderBy(F.desc("recorded_at"))))
        .where("_r = 1")
        .select("metric_name", "source", "table_name", "metric_value", F.lit(None).cast("string").alias("error"))
    )
    compared = (
        results.where(F.col("result_type").isin(*COMPARISONS))
        .withColumn("_r", F.row_number().over(by_time.orderBy(F.desc("computed_at"), "result_type")))
        .where("_r = 1")
        .select(
            "metric_name",
            F.col("result_type").alias("comparison_type"),
            "baseline_value",
            "change_pct",
            "exceeds_threshold",
            "trend_direction",
            F.col("forecast_days").alias("forecast_threshold_days"),
        )
    )
    return monitor_categorize(value, compared)


def metric_history_window(
    history: DataFrame, now: datetime | Column, n_days: int, metric: str | None = None, limit: int | None = None
) -> DataFrame:
    """Values of the last ``n_days`` days, newest first; at most ``limit`` rows if the caller sets one."""
    if not 1 <= n_days <= 365:
        raise ValueError("n_days must be within 1 to 365")
    rows = history if metric is None else history.where(F.col("metric_name") == metric)
    out = rows.where(F.col("recorded_at") >= moment(now) - days(n_days)).orderBy(F.desc("recorded_at"), "metric_name")
    return out if limit is None else out.limit(limit)


def run_monitors(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    monitors: Sequence[Monitor],
    history: DataFrame,
    now: datetime | Column,
    sources: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluate, compare and categorise; returns (values, comparisons, results).

    Nothing is stored; ``monitor_run.MonitorStore.run`` stores the values, the comparisons and the drill-downs.
    """
    chosen = list(monitors) if sources is None else [m for m in monitors if m.source in set(sources)]
    values = metric_eval(spark, tables, chosen, now)
    fields = HISTORY_SCHEMA.fieldNames()
    fresh = values.where(F.col("error").isNull()).select(*fields)
    everything = history.select(*fields).unionByName(fresh)
    compared = monitor_compare(everything, settings(spark, chosen), now)
    # A metric that failed now has no comparison, whatever its history says.
    compared = compared.join(fresh.select("metric_name"), "metric_name", "left_semi")
    return values, compared, monitor_categorize(values, compared)
