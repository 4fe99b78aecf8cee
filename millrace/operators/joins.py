"""The joins that loading, monitoring and reshaping need.

None carries a broadcast hint: sides are broadcast when Spark measures them as small, and the
skew handling of adaptive execution splits the large ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.names import quoted


def join_inner_latest(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows at the newest time of their key; ties stay. One shuffle instead of a self join."""
    order = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(F.col(quoted(ts)).desc())
    return df.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")


def join_left_equi(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """All rows of the left side with the columns of the right one."""
    same = [left[quoted(a)] == right[quoted(b)] for a, b in on.items()]
    return left.join(right, same, "left").drop(*[right[quoted(b)] for b in on.values()])


def join_full_outer_compare(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Union of the keys of two snapshots with both values; NULL keys match each other."""
    a = current.select(*[quoted(k) for k in keys], F.col(quoted(value)).alias("current"), F.lit(1).alias("_a")).alias("a")
    b = previous.select(*[quoted(k) for k in keys], F.col(quoted(value)).alias("previous"), F.lit(1).alias("_b")).alias("b")
    same = [F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) for k in keys]
    change = (
        F.when(F.col("a._a").isNull(), "removed")
        .when(F.col("b._b").isNull(), "added")
        .when(F.col("current").eqNullSafe(F.col("previous")), "same")
        .otherwise("changed")
    )
    key = [F.when(F.col("a._a").isNotNull(), F.col(f"a.{quoted(k)}")).otherwise(F.col(f"b.{quoted(k)}")).alias(k) for k in keys]
    return a.join(b, same, "full").select(*key, "current", "previous", change.alias("change"))


def join_anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left side whose key the right one does not have."""
    return left.join(right.select(*[quoted(k) for k in keys]).distinct(), list(keys), "left_anti")


def join_semi_select(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list."""
    return df.join(chosen.select(quoted(key)).distinct(), key, "left_semi")


def join_nearest_time(df: DataFrame, keys: Sequence[str], ts: str, value: str, moment: Column) -> DataFrame:
    """Per key the value nearest in time to a moment, on either side: an aggregate, not a join."""
    rows = df.withColumn("_moment", moment)
    gap = F.abs(F.unix_micros(F.col(quoted(ts)).cast("timestamp")) - F.unix_micros(F.col("_moment").cast("timestamp")))
    best = F.min_by(F.struct(F.col(quoted(value)).alias("value"), F.col(quoted(ts)).alias("at")), F.struct(gap, quoted(ts), quoted(value)))
    return rows.groupBy(*[quoted(k) for k in keys]).agg(best.alias("_b")).select(*keys, "_b.value", "_b.at")


def join_map_lookup(df: DataFrame, mapping: DataFrame, column: str, out: str) -> DataFrame:
    """Labels for ids by a mapping (key, label); an id without label stays as text."""
    labels = mapping.select(F.col("key").cast("string").alias("_key"), F.col("label").alias("_label"))
    text = F.col(quoted(column)).cast("string")
    joined = df.join(labels, text == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_label", text)).drop("_key", "_label")


def join_parent_child(messages: DataFrame, thread: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Replies with the first message of their thread; the first message itself is no reply."""
    parent = messages.groupBy(quoted(thread)).agg(
        F.min_by(F.struct(F.col(quoted(ts)).alias(ts), *[F.col(quoted(c)).alias(c) for c in columns]), quoted(ts)).alias("parent")
    )
    joined = messages.join(parent, thread)
    return joined.where(F.col(quoted(ts)) != F.col("parent").getField(ts)).select(
        *messages.columns,
        F.col("parent").getField(ts).alias(f"parent_{ts}"),
        *[F.col("parent").getField(c).alias(f"parent_{c}") for c in columns],
    )
