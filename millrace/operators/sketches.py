"""Profiles from stored sketches: a load reads its own files, the profile of the table is united from what is stored.

For every unit (file or folder) and column one row is kept: counts, bounds, a sum, a HyperLogLog sketch of the values and
a KLL sketch of the numbers. All of them merge, so the table's profile is an aggregation of these small rows; a changed
or deleted unit replaces or loses its rows, which no running total could do.

Stated errors: distinct counts have a relative standard error of ``1.04 / sqrt(2 ** LG_K)`` (0.8 %), three of them are
``DISTINCT_ERROR``; the rank of a quantile is within ``RANK_ERROR``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import INTERNAL_PREFIXES, NUMERIC, TEXT, quoted, user_columns
from millrace.operators.profile import NESTED, as_text
from millrace.sources.file_load import FileLoader
from millrace.sources.store import KeyedTable

LG_K = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
KLL_K = 400
RANK_ERROR = 0.02

STORED = (
    "unit string, column_name string, row_count bigint, value_count bigint, min_value double, max_value double, total double, "
    "min_length int, max_length int, distinct_sketch binary, quantile_sketch binary"
)


def unit_sketches(rows: DataFrame, unit: str = "_src_file", prefixes: Sequence[str] = INTERNAL_PREFIXES) -> DataFrame:
    """One row for each unit and column (``STORED``), in one scan; partial sketches merge before the shuffle."""
    fields = [f for f in user_columns(rows, prefixes) if f.name != unit]
    none = F.lit(None)
    aggregates, structs = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(fields):
        col = F.col(quoted(f.name))
        number, text = isinstance(f.dataType, NUMERIC), isinstance(f.dataType, TEXT)
        value = as_text(f.name, f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType, *NESTED)) else col
        hashed = F.when(col.isNotNull(), F.xxhash64(value))
        facts = {
            "value_count": F.count(col),
            "min_value": F.min(col).cast("double") if number else none.cast("double"),
            "max_value": F.max(col).cast("double") if number else none.cast("double"),
            "total": F.sum(col.cast("double")) if number else none.cast("double"),
            "min_length": F.min(F.length(col)) if text else none.cast("int"),
            "max_length": F.max(F.length(col)) if text else none.cast("int"),
            "distinct_sketch": F.hll_sketch_agg(hashed, F.lit(LG_K)),
            "quantile_sketch": F.kll_sketch_agg_double(col.cast("double"), F.lit(KLL_K)) if number else none.cast("binary"),
        }
        structs.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n").alias("row_count"), *[F.col(f"{k}{i}").alias(k) for k in facts]))
        aggregates += [v.alias(f"{k}{i}") for k, v in facts.items()]
    wide = rows.groupBy(F.col(quoted(unit)).alias("unit")).agg(*aggregates)
    return wide.select("unit", F.inline(F.array(*structs))).select(*[f.name for f in _stored(rows.sparkSession).fields])


def _stored(spark: SparkSession) -> T.StructType:
    return spark.createDataFrame([], STORED).schema


class ProfileStore:
    """The sketches of a loader's units, as a table below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.table = KeyedTable(spark, f"{path.rstrip('/')}/sketches", ["unit"], buckets=16)

    def sketches(self) -> DataFrame:
        stored = self.table.read() if self.table.exists() else self.spark.createDataFrame([], STORED)
        return stored.where(F.col("column_name").isNotNull())

    def update(self, loader: FileLoader, outcome: DataFrame) -> None:
        """Bring the sketches to the outcome of a load: only the units that it loaded are read.

        A deleted unit leaves a row without column behind, which replaces its sketches.
        """
        fresh = unit_sketches(loader.rows_of(outcome))
        deleted = outcome.where(F.col("state") == "deleted").select(F.col("file_path").alias("unit"))
        self.table.delete_insert(fresh.unionByName(deleted, allowMissingColumns=True))

    def profile(self) -> DataFrame:
        return unite(self.sketches())


def unite(sketches: DataFrame) -> DataFrame:
    """The profile of a table from the sketches of its units: a row for each column."""
    total = sketches.groupBy("unit").agg(F.max("row_count").alias("n")).agg(F.sum("n").alias("rows")).scalar()
    united = sketches.groupBy("column_name").agg(
        F.sum("value_count").alias("value_count"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.try_divide(F.sum("total"), F.sum(F.when(F.col("total").isNotNull(), F.col("value_count")))).alias("mean_value"),
        F.min("min_length").alias("min_length"),
        F.max("max_length").alias("max_length"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"),
    )
    some = F.col("_quantiles").isNotNull() & (F.kll_sketch_get_n_double("_quantiles") > 0)
    quantiles = {"median": 0.5, "p95": 0.95}
    cuts = [F.when(some, F.kll_sketch_get_quantile_double("_quantiles", F.lit(q))).alias(n) for n, q in quantiles.items()]
    # a column that a unit does not have is null in all of its rows
    rows = total.alias("row_count"), (total - F.col("value_count")).alias("null_count")
    kept = ("distinct_count", "min_value", "max_value", "mean_value", "min_length", "max_length")
    return united.select("column_name", *rows, *kept, *cuts)
