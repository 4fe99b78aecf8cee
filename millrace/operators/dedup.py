"""One row per key, by several policies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.names import quoted

# Columns that tell when a row last changed.
MODIFIED_NAMES = ("updated_at", "modified_at")

UNORDERED = (T.MapType, T.VariantType)


def total_order(df: DataFrame, first: Sequence[Column]) -> list[Column]:
    """An order without ties between different rows: a recomputed task picks the same row."""
    rest = [F.col(quoted(f.name)) for f in df.schema.fields if not isinstance(f.dataType, UNORDERED)]
    return [*first, *rest]


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. The bound reaches the map side: each task ships one row per key."""
    window = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*total_order(df, order))
    return df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") == 1).drop("_nth")


def dedup_last_modified(df: DataFrame, keys: Sequence[str], modified: str) -> DataFrame:
    return first_row(df, keys, [F.col(quoted(modified)).desc_nulls_last()])


def dedup_first_seen(df: DataFrame, keys: Sequence[str], seen: str) -> DataFrame:
    return first_row(df, keys, [F.col(quoted(seen)).asc_nulls_last()])


def dedup_composite_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per column tuple, the smallest by all other columns."""
    return first_row(df, keys, [])


def dedup_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_row(df, keys, order)


def infer_dedup(columns: Sequence[str]) -> tuple[str, str] | None:
    """The (key, modified) columns that speak for keeping the last modified row, if any."""
    lower = [c.lower() for c in columns]
    modified = next((c for c in lower if c in MODIFIED_NAMES), None)
    key = next((c for c in lower if re.fullmatch(r"id|.*_id", c)), None)
    if modified is None or key is None:
        return None
    return columns[lower.index(key)], columns[lower.index(modified)]


def apply_policy(df: DataFrame, policy: str, keys: Sequence[str] = (), modified: str | None = None) -> DataFrame:
    """Spreadsheet policies: ``latest_only`` keeps the newest row per key, the others keep all."""
    if policy in ("append_only", "none"):
        return df
    if policy != "latest_only":
        raise ValueError(f"unknown policy {policy!r}")
    if not keys or modified is None:
        found = infer_dedup(df.columns)
        if found is None:
            return df
        keys, modified = [found[0]], found[1]
    return dedup_last_modified(df, keys, modified)
