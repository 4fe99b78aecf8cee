"""The next event of a key, without putting a whole key in one task.

A window over a key sorts all its rows in one task, which a key with a third of the rows
does not survive. Here rows are grouped by key *and* time bucket; only the first time of each
bucket is compared across buckets. An hour is the default: a key with a third of a large table's
rows still has thousands of buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.names import quoted


def next_time(df: DataFrame, keys: Sequence[str], ts: str, out: str = "next_time", bucket: str = "hour") -> DataFrame:
    """Add the time of the key's following row (NULL for its last one)."""
    return neighbour(df, keys, ts, {ts: out}, bucket, forward=True)


def previous_time(df: DataFrame, keys: Sequence[str], ts: str, out: str = "previous_time", bucket: str = "hour") -> DataFrame:
    """Add the time of the key's preceding row (NULL for its first one)."""
    return neighbour(df, keys, ts, {ts: out}, bucket, forward=False)


def neighbour(df: DataFrame, keys: Sequence[str], ts: str, columns: Mapping[str, str], bucket: str = "hour", forward: bool = False) -> DataFrame:
    """Add columns of the key's following or preceding row, under new names.

    Times of a key should differ; rows of the same time follow each other in no certain order.
    """
    names = [quoted(k) for k in keys]
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.col(quoted(ts))).cast(df.schema[ts].dataType))
    carried = F.struct(*[F.col(quoted(c)).alias(out) for c, out in columns.items()])
    step = F.lead if forward else F.lag
    inside = Window.partitionBy(*names, "_bucket").orderBy(quoted(ts))
    # One row per key and bucket, combined map-side: its first row seen from before, its last from after.
    if list(columns) == [ts]:
        # The time alone needs no by-aggregate, whose struct buffers would make Spark sort first.
        edge = F.struct((F.min if forward else F.max)(quoted(ts)).alias(columns[ts]))
    else:
        edge = (F.min_by if forward else F.max_by)(carried, quoted(ts))
    edges = rows.groupBy(*names, "_bucket").agg(edge.alias("_edge"))
    across = edges.withColumn("_beyond", step("_edge").over(Window.partitionBy(*names).orderBy("_bucket"))).drop("_edge")
    near = rows.withColumn("_near", step(carried).over(inside))
    a, b = near.alias("a"), across.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*names, "_bucket"]]
    found = F.coalesce("a._near", "b._beyond")
    return a.join(b, same, "left").select(
        *[F.col(f"a.{quoted(c)}") for c in df.columns], *[found.getField(out).alias(out) for out in columns.values()]
    )
