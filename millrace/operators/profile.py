"""Column profiles: null, distinct, range and length statistics, and sample values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.names import INTERNAL_PREFIXES, NUMERIC, TEXT, first_line, quoted, user_columns, user_tables
from millrace.operators.monitor import moment
from millrace.session import materialize

# Fixed value: sample values stored per column.
SAMPLE_SIZE = 5

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

PROFILE_COLUMNS = (
    "source", "table_name", "column_name", "row_count", "null_count", "null_pct", "distinct_count",
    "min_value", "max_value", "mean_value", "min_length", "max_length",
)


def as_text(name: str, dtype: T.DataType) -> Column:
    """A value as text, equal values giving equal text."""
    col = F.col(quoted(name))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = col + F.lit(0).cast(dtype)  # -0.0 and 0.0 are one value
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, NESTED):
        return F.to_json(col, {"ignoreNullFields": "false"})  # a cast to text does not quote what is inside
    return col.cast("string")


def melt(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Rows (column_name, value) of all given columns, NULLs left out, in one scan."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), as_text(f.name, f.dataType).alias("value")) for f in fields])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def melt_typed(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Rows (column_name, l, d, s) of all given columns, NULLs left out, in one scan.

    A value is in the slot of its type: whole numbers and times as numbers, fractions, or text.
    Numbers are not turned into text, and text is its digest.
    """
    pairs = []
    for f in fields:
        col = F.col(quoted(f.name))
        slots = {"l": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            slots["l"] = col.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            slots["l"] = F.unix_date(col).cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            slots["l"] = F.unix_micros(col.cast("timestamp"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            slots["d"] = col.cast("double")
        else:
            slots["s"] = F.sha2(as_text(f.name, f.dataType), 256)
        pairs.append(F.struct(F.lit(f.name).alias("column_name"), col.isNotNull().alias("_set"), *[v.alias(k) for k, v in slots.items()]))
    return df.select(F.inline(F.array(*pairs))).where("_set").drop("_set")


def value_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """How often each value of each column occurs.

    Equal values combine map-side, so one held by a third of the rows is one row per task; the
    shuffle spreads by value, not by column.
    """
    return melt_typed(df, fields).groupBy("column_name", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Exact distinct count per column by two plain aggregations (text by its sha-256)."""
    return value_counts(df, fields).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


def column_facts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Everything but distinct counts, of all columns in one aggregation over one scan."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        col = F.col(quoted(f.name))
        aggs.append(F.count(col).alias(f"c{i}"))
        if isinstance(f.dataType, NUMERIC):
            aggs += [F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}"), F.avg(col).alias(f"mean{i}")]
        elif isinstance(f.dataType, TEXT):
            aggs += [F.min(F.length(col)).alias(f"lo{i}"), F.max(F.length(col)).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    none = F.lit(None)
    rows = []
    for i, f in enumerate(fields):
        numeric, text = isinstance(f.dataType, NUMERIC), isinstance(f.dataType, TEXT)
        missing = F.col("n") - F.col(f"c{i}")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.col("n").alias("row_count"),
                missing.alias("null_count"),
                F.coalesce(F.round(F.try_divide(missing * 100.0, F.col("n")), 1), F.lit(0.0)).cast("double").alias("null_pct"),
                (F.col(f"lo{i}") if numeric else none).cast("double").alias("min_value"),
                (F.col(f"hi{i}") if numeric else none).cast("double").alias("max_value"),
                (F.col(f"mean{i}") if numeric else none).cast("double").alias("mean_value"),
                (F.col(f"lo{i}") if text else none).cast("int").alias("min_length"),
                (F.col(f"hi{i}") if text else none).cast("int").alias("max_length"),
                (F.col(f"lo{i}") if numeric else none).cast("string").alias("min_text"),
                (F.col(f"hi{i}") if numeric else none).cast("string").alias("max_text"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def profile_table(
    df: DataFrame, source: str, table: str, approximate: bool = False, prefixes: Sequence[str] = INTERNAL_PREFIXES
) -> DataFrame:
    """One typed row per column. ``approximate`` counts distinct values by sketch, in one scan."""
    fields = user_columns(df, prefixes)
    if not fields:
        raise ValueError(f"table {table} has no user columns")
    counts = profile_distinct_approx(df, prefixes) if approximate else distinct_counts(df, fields)
    return column_facts(df, fields).join(counts, "column_name", "left").select(
        F.lit(source).alias("source"),
        F.lit(table).alias("table_name"),
        *[
            F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias(c) if c == "distinct_count" else F.col(c)
            for c in PROFILE_COLUMNS[2:]
        ],
        "min_text",
        "max_text",
    )


def profile_distinct_approx(df: DataFrame, prefixes: Sequence[str] = INTERNAL_PREFIXES, error: float = 0.02) -> DataFrame:
    """Distinct counts by sketch: one scan, and a shuffle of one sketch per column and task."""
    fields = user_columns(df, prefixes)
    values = [as_text(f.name, f.dataType) if isinstance(f.dataType, NESTED) else F.col(quoted(f.name)) for f in fields]
    wide = df.agg(*[F.approx_count_distinct(v, error).alias(f"d{i}") for i, v in enumerate(values)])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"d{i}").alias("distinct_count")) for i, f in enumerate(fields)]
    return wide.select(F.inline(F.array(*rows)))


def value_sample(df: DataFrame, fields: Sequence[T.StructField], n: int) -> DataFrame:
    """Up to ``n`` distinct non-empty values of every column: those with the smallest md5.

    Two scans instead of a shuffle of all text. The first finds the digests: equal ones combine
    map-side, and the bound on row_number keeps ``n`` per column and task. The second fetches
    their values by a join with at most ``n`` digests per column, which Spark broadcasts once it has measured them.
    """
    values = melt(df, fields).where(F.col("value") != "").withColumn("digest", F.md5("value"))
    order = Window.partitionBy("column_name").orderBy("digest")
    chosen = (
        values.groupBy("column_name", "digest")
        .agg(F.lit(1).alias("_one"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= n)
        .select("column_name", "digest", "nth")
    )
    return (
        values.join(chosen, ["column_name", "digest"])
        .groupBy("column_name", "nth", "digest")
        .agg(F.first("value").alias("value"))
        .select("column_name", "nth", "value")
    )


def profile_sample_values(df: DataFrame, n: int = SAMPLE_SIZE, prefixes: Sequence[str] = INTERNAL_PREFIXES) -> DataFrame:
    """Up to ``n`` distinct values per column, as a sorted array and as JSON."""
    sample = value_sample(df, user_columns(df, prefixes), n)
    return (
        sample.groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
        .withColumn("sample_json", F.to_json("sample_values"))
    )


def profile_stats(profile: DataFrame, now: datetime | Column, samples: DataFrame | None = None) -> DataFrame:
    """A profile as rows (column, stat_type, stat_value text) to merge into the stored statistics."""
    stats = {
        "null_count": F.col("null_count").cast("string"),
        "null_pct": F.col("null_pct").cast("string"),
        "distinct_count": F.col("distinct_count").cast("string"),
        "min": F.col("min_text"),
        "max": F.col("max_text"),
        "mean": F.col("mean_value").cast("string"),
        "min_length": F.col("min_length").cast("string"),
        "max_length": F.col("max_length").cast("string"),
    }
    wide = profile
    if samples is not None:
        wide = profile.join(samples.select("column_name", "sample_json"), "column_name", "left")
        stats["sample_values"] = F.col("sample_json")
    pairs = F.array(*[F.struct(F.lit(k).alias("stat_type"), v.alias("stat_value")) for k, v in stats.items()])
    per_column = wide.select("source", "table_name", "column_name", F.inline(pairs)).where(F.col("stat_value").isNotNull())
    per_table = profile.groupBy("source", "table_name").agg(F.max("row_count").cast("string").alias("stat_value"))
    total = per_table.select(
        "source", "table_name", F.lit("__row_count__").alias("column_name"), F.lit("row_count").alias("stat_type"), "stat_value"
    )
    return per_column.unionByName(total).withColumn("updated_at", moment(now))


def profile_many(tables: Mapping[str, DataFrame], source: str, prefixes: Sequence[str] = INTERNAL_PREFIXES) -> tuple[DataFrame | None, dict[str, str]]:
    """Profiles of all user tables of a source and of its ``stg_{source}__`` tables.

    Returns the union and the reason for every table that cannot be profiled. Each profile is written when it is made,
    a row for each column, so that a table which fails at run time fails alone.
    """
    parts, errors = [], {}
    for name in user_tables(sorted(tables), prefixes):
        if name.startswith("stg_") and not name.startswith(f"stg_{source}__"):
            continue
        try:
            parts.append(materialize(profile_table(tables[name], source, name, prefixes=prefixes), "profile"))
        except (PySparkException, ValueError) as error:
            errors[name] = first_line(error)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out, errors
