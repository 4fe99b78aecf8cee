"""Which groups of a dimension made a metric move."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.names import first_line
from millrace.operators.monitor import Monitor, change_pct, moment
from millrace.session import materialize

# Fixed value: contributors reported per dimension.
TOP_CONTRIBUTORS = 3

BREAKDOWN = "metric_name string, dimension string, group_value string, value double"


def drill_breakdown(df: DataFrame, monitor: Monitor, dimensions: Sequence[str] | None = None) -> DataFrame:
    """Metric value of every group of each dimension.

    All dimensions share one scan: every row is expanded to one row per dimension and the
    aggregation combines map-side before its shuffle. ``largest_groups`` bounds what a report shows.
    """
    dims = list(dimensions or monitor.drill_down)
    if not dims:
        raise ValueError(f"monitor {monitor.name} has no dimension to drill into")
    base = df if monitor.filter is None else df.where(monitor.filter)
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("val")) for d in dims])
    return (
        base.withColumn("_pair", F.explode(pairs))
        .groupBy(F.col("_pair.dim").alias("dimension"), F.col("_pair.val").alias("group_value"))
        .agg(F.coalesce(F.expr(monitor.value).try_cast("double"), F.lit(0.0)).alias("value"))
        .select(F.lit(monitor.name).alias("metric_name"), "dimension", "group_value", "value")
    )


def largest_groups(breakdown: DataFrame, top: int) -> DataFrame:
    """The ``top`` groups of each metric and dimension by absolute value, for display."""
    order = Window.partitionBy("metric_name", "dimension").orderBy(F.abs("value").desc(), F.col("group_value").asc_nulls_first())
    return breakdown.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def drill_snapshot(snapshots: DataFrame) -> DataFrame:
    """The rows of the newest stored snapshot of every metric and dimension.

    The newest time of each is one row, found map-side first, so no task sorts the rows of a snapshot.
    """
    keys = ["metric_name", "dimension", "computed_at"]
    newest = snapshots.groupBy(*keys[:2]).agg(F.max("computed_at").alias("computed_at"))
    return snapshots.join(newest, keys, "left_semi").select(*snapshots.columns)


def stamp_snapshot(breakdown: DataFrame, now: datetime | Column) -> DataFrame:
    """A breakdown as rows to append to the stored snapshots."""
    return breakdown.withColumn("computed_at", moment(now))


def drill_contributors(current: DataFrame, previous: DataFrame, top: int = TOP_CONTRIBUTORS) -> DataFrame:
    """The groups with the largest change against the previous snapshot.

    A vanished group counts as 0, a new group has no change; a dimension never stored before
    has no contributors at all. NULL is a group like any other.
    """
    keys = ["metric_name", "dimension", "group_value"]
    now_side = current.select(*keys, F.col("value").alias("_now"), F.lit(True).alias("_in_now"))
    old_side = previous.select(*keys, F.col("value").alias("previous_value"), F.lit(True).alias("_in_old"))
    a, b = now_side.alias("a"), old_side.alias("b")
    matched = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    known = F.col("b._in_old").isNotNull()
    both = a.join(b, matched, "full").select(
        *[F.when(F.col("a._in_now"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys],
        F.coalesce("a._now", F.lit(0.0)).alias("current_value"),
        F.when(known, F.col("b.previous_value")).alias("previous_value"),
    )
    stored = previous.select("metric_name", "dimension").distinct()
    changed = (
        both.join(stored, ["metric_name", "dimension"], "left_semi")
        .withColumn("change_abs", F.col("current_value") - F.col("previous_value"))
        .withColumn("change_pct", change_pct(F.col("current_value"), F.col("previous_value")))
    )
    size = F.coalesce(F.abs("change_abs"), F.lit(0.0))
    order = Window.partitionBy("metric_name", "dimension").orderBy(size.desc(), F.col("group_value").asc_nulls_first())
    return changed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def drill_flagged(
    tables: Mapping[str, DataFrame], monitors: Sequence[Monitor], results: DataFrame, snapshots: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Breakdown and contributors of the metrics whose threshold was crossed, and the dimensions that failed.

    The names of flagged metrics come to the driver (no more than there are monitors), so that
    tables of metrics in good order are not scanned. Each breakdown is written to the shared folder, all dimensions
    of a metric at once, one by one if that fails; a dimension that fails alone is a row of the third
    table (metric_name, dimension, error).
    """
    flagged = {r["name"] for r in results.where("exceeds_threshold").select("name").collect()}
    parts: list[DataFrame] = []
    errors: list[tuple[str, str, str]] = []
    for m in monitors:
        if m.name in flagged and m.drill_down:
            found, failed = _broken_down(tables[m.table], m, list(m.drill_down))
            parts += found
            errors += failed
    if not parts and not errors:
        return None
    spark = results.sparkSession
    failed_pairs = {(name, dimension) for name, dimension, _ in errors}
    asked = [(m.name, d) for m in monitors if m.name in flagged for d in m.drill_down if (m.name, d) not in failed_pairs]
    pairs = spark.createDataFrame(asked, "metric_name string, dimension string").distinct()
    # a metric that was not drilled into now has not lost the groups of its last snapshot
    before = drill_snapshot(snapshots.join(pairs, ["metric_name", "dimension"], "left_semi"))
    current = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], BREAKDOWN)
    failures = spark.createDataFrame(errors, "metric_name string, dimension string, error string")
    return current, drill_contributors(current, before), failures


def _broken_down(df: DataFrame, monitor: Monitor, dimensions: Sequence[str]) -> tuple[list[DataFrame], list[tuple[str, str, str]]]:
    try:
        return [materialize(drill_breakdown(df, monitor, dimensions), "drill")], []
    except (PySparkException, Py4JJavaError) as error:
        if len(dimensions) == 1:
            return [], [(monitor.name, dimensions[0], first_line(error))]
    parts, errors = [], []
    for dimension in dimensions:
        found, failed = _broken_down(df, monitor, [dimension])
        parts += found
        errors += failed
    return parts, errors
