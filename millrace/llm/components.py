"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """The lowest neighbour of each first end; combined in each task before it is shuffled."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every end of an edge; the root is the smallest node reachable.

    The ends are of one orderable type. Loops, repeated and reversed edges and null ends change nothing; without
    edges the result is empty. The number of edges never grows, and each round's edges are written to the shared
    folder, so a lost executor repeats at most one round. Only a count and a checksum reach the driver.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    current = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = _lowest(large)
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
