"""Schema drift: what columns a source delivers, against its accepted baseline.

A schema is a table (source, table_name, column_name, column_type): of columns, or of the keys
inside a JSON column, counted per row so that the work is done by the executors.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.names import INTERNAL_PREFIXES, is_internal, quoted
from millrace.operators.monitor import moment

# Kinds of drift and those that break what reads the table.
ADDED, REMOVED, RETYPED = "column_added", "column_removed", "type_changed"
BREAKING = (REMOVED, RETYPED)

SCHEMA_KEYS = ["source", "table_name", "column_name"]


def observed_schema(spark: SparkSession, source: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns and types of the user tables of a source."""
    rows = [
        (source, name, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        if not is_internal(name, INTERNAL_PREFIXES)
        for f in df.schema.fields
        if not is_internal(f.name, INTERNAL_PREFIXES)
    ]
    return spark.createDataFrame(rows, "source string, table_name string, column_name string, column_type string")


def observed_keys(df: DataFrame, column: str, source: Column, table: Column) -> DataFrame:
    """Keys of a JSON column with the type and the number of rows of each.

    Text that is not a JSON object contributes nothing. Counting combines map-side.
    """
    spark = df.sparkSession
    parsed = df.select(source.alias("source"), table.alias("table_name"), F.try_parse_json(quoted(column)).alias("_json"))
    pairs = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_json").outer()))
    # Precision and length are no drift: 1.5 and 10.25 are the same type.
    kind = F.lower(F.regexp_replace(F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0), "^DECIMAL$", "DOUBLE"))
    return (
        pairs.where(F.col("key").isNotNull())
        .groupBy("source", "table_name", F.col("key").alias("column_name"), kind.alias("column_type"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# --- all paths of nested values ----------------------------------------------------------


def _reject(*_: object) -> None:
    raise ValueError


def _object(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    return found if len(found) == len(pairs) else _reject()


def _walk(value: object, path: str, found: set[tuple[str, str]]) -> None:
    """Add (path, kind) of a value and of all that is in it; an element of a list has the path of the list and ``[]``."""
    stack = [(value, path)]
    while stack:
        value, path = stack.pop()
        if isinstance(value, dict):
            kind = "object"
            stack += [(v, f"{path}.{k}" if path else k) for k, v in value.items()]
        elif isinstance(value, list):
            kind = "array"
            stack += [(v, f"{path}[]") for v in value]
        elif value is None:
            kind = "null"
        elif isinstance(value, bool):
            kind = "boolean"
        elif isinstance(value, int):
            kind = "int" if -(1 << 31) <= value < 1 << 31 else "bigint" if -(1 << 63) <= value < 1 << 63 else "double"
        else:
            kind = "double" if isinstance(value, float) else "string"
        if path:
            found.add((path, kind))


def observed_paths(df: DataFrame, column: str, source: Column, table: Column, most: int = 100_000) -> DataFrame:
    """Every path inside a JSON column, at any depth, with its kinds and the number of rows that have each.

    Tasks count the paths of their rows and hand on counts, not values; a task that holds ``most`` of them hands them on
    early, which changes no sum. Text that is no JSON object, or repeats a key, contributes nothing. Numbers are ``int``,
    ``bigint`` or ``double`` by the width they need.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple] = Counter()

        def out() -> pa.RecordBatch:
            rows = [[*key, n] for key, n in counts.items()]
            columns = [pa.array(list(x), pa.int64() if k == 4 else pa.string()) for k, x in enumerate(zip(*rows, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names=[*SCHEMA_KEYS, "kind", "rows"])

        for batch in batches:
            for origin, name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    value = json.loads(text or "null", object_pairs_hook=_object, parse_constant=_reject)
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    found: set[tuple[str, str]] = set()
                    _walk(value, "", found)
                    counts.update((origin, name, path, kind) for path, kind in found)
            if len(counts) >= most:
                yield out()
                counts.clear()
        if counts:
            yield out()

    texts = df.select(source.alias("source"), table.alias("table_name"), F.col(quoted(column)).alias("text"))
    partial = texts.mapInArrow(run, "source string, table_name string, column_name string, kind string, rows bigint")
    return partial.groupBy(*SCHEMA_KEYS, "kind").agg(F.sum("rows").alias("rows"))


def paths_as_schema(paths: DataFrame) -> DataFrame:
    """One type per path: the least one that holds all kinds seen there.

    null < anything; int < bigint < double. Kinds that have no common type are told side by side, joined by a bar. The
    kinds of a path are eight at most, and taking the least type of parts first gives the same.
    """
    numbers = F.array(F.lit("double"), F.lit("bigint"), F.lit("int"))
    kinds = F.col("_kinds")
    widest = F.filter(numbers, lambda k: F.array_contains(kinds, k))
    rest = F.array_except(kinds, F.concat(numbers, F.array(F.lit("null"))))
    types = F.array_sort(F.concat(rest, F.slice(widest, 1, 1)))
    merged = F.when(F.size(types) == 0, "null").otherwise(F.array_join(types, "|"))
    return paths.groupBy(*SCHEMA_KEYS).agg(F.collect_set("kind").alias("_kinds")).select(*SCHEMA_KEYS, merged.alias("column_type"))


def keys_as_schema(keys: DataFrame) -> DataFrame:
    """One type per key: the types seen, in order, joined by a bar (there are six at most)."""
    return keys.groupBy(*SCHEMA_KEYS).agg(F.array_join(F.array_sort(F.collect_set("column_type")), "|").alias("column_type"))


def drift_events(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Columns added, removed or retyped since the baseline.

    A table without a baseline is stored silently, a table that was not observed is not judged.
    """
    tables = ["source", "table_name"]
    known = baseline.select(*tables).distinct()
    seen = current.select(*tables).distinct()
    old = baseline.join(seen, tables, "left_semi").select(*SCHEMA_KEYS, F.col("column_type").alias("_old"))
    new = current.join(known, tables, "left_semi").select(*SCHEMA_KEYS, F.col("column_type").alias("_new"))
    a, b = F.col("_old"), F.col("_new")
    kind = F.when(a.isNull(), ADDED).when(b.isNull(), REMOVED).when(a != b, RETYPED)
    detail = (
        F.when(a.isNull(), F.concat(F.lit("type="), b)).when(b.isNull(), F.concat(F.lit("was="), a)).otherwise(F.concat(a, F.lit(" -> "), b))
    )
    return (
        old.join(new, SCHEMA_KEYS, "full")
        .withColumn("event_type", kind)
        .where(F.col("event_type").isNotNull())
        .select(
            *SCHEMA_KEYS,
            "event_type",
            F.when(F.col("event_type").isin(*BREAKING), "breaking").otherwise("additive").alias("severity"),
            detail.alias("detail"),
        )
    )


def drift_apply(baseline: DataFrame, current: DataFrame, now: datetime | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, new baseline, sources needing attention) of one observation.

    A table with a breaking change keeps its baseline until it is accepted, so the drift is
    found again; additive changes and new tables move it. The events of an attention row are
    in the event table.
    """
    events = drift_events(baseline, current).withColumn("detected_at", moment(now))
    tables = ["source", "table_name"]
    blocked = events.where(F.col("severity") == "breaking").select(*tables).distinct()
    seen = current.select(*tables).distinct()
    moving = seen.join(blocked, tables, "left_anti")
    fields = [*SCHEMA_KEYS, "column_type"]
    new_baseline = (
        current.join(moving, tables, "left_semi").select(*fields).unionByName(baseline.join(moving, tables, "left_anti").select(*fields))
    )
    broken = F.col("severity") == "breaking"
    # Fixed value: the wording of the reason.
    attention = (
        events.groupBy("source")
        .agg(F.count_if(broken).alias("n"))
        .where("n > 0")
        .select("source", F.concat(F.col("n").cast("string"), F.lit(" breaking schema change(s) detected")).alias("reason"), moment(now).alias("created_at"))
    )
    return events, new_baseline, attention


def drift_accept(baseline: DataFrame, current: DataFrame, attention: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Take what a source delivers now as its baseline and clear its flag.

    A baseline table that is not there any more keeps its rows.
    """
    tables = ["source", "table_name"]
    mine = F.col("source") == source
    now_rows = current.where(mine).join(baseline.select(*tables).distinct(), tables, "left_semi")
    fields = [*SCHEMA_KEYS, "column_type"]
    kept = baseline.join(now_rows.select(*tables).distinct(), tables, "left_anti")
    return kept.select(*fields).unionByName(now_rows.select(*fields)), attention.where(~mine)


def governance_query(
    df: DataFrame, time: str, filters: Mapping[str, object] | None = None, *, limit: int, offset: int = 0
) -> DataFrame:
    """A page of events, findings or runs: filtered, newest first, with the total on each row.

    The page is a distributed top-k; other columns break ties so that pages do not overlap.
    """
    rows = df
    for column, value in (filters or {}).items():
        if value is not None:
            rows = rows.where(F.col(quoted(column)) == value)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    rest = [F.col(quoted(c)) for c in df.columns if c != time]
    page = rows.orderBy(F.col(quoted(time)).desc_nulls_last(), *rest).offset(offset).limit(limit)
    return page.withColumn("total", total)


def _literal(value: object, kind: T.DataType) -> Column:
    """A value of a row as a column; a time without zone goes as text, since a plain literal would take on a zone."""
    return F.lit(str(value) if isinstance(kind, T.TimestampNTZType) and value is not None else value).cast(kind)


def keyset_page(
    df: DataFrame, time: str, limit: int, after: Row | None = None, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The page of at most ``limit`` rows behind the row ``after``, newest first; the first page without one.

    The last row of a page is the cursor of the next. A page is found by its place in the total order of time and all other
    columns, not by counting the rows before it, so it costs a filter that the scan prunes by and a top-k, and rows that are
    added meanwhile neither repeat nor hide any. Rows equal in all columns cannot be told apart and come on one page or
    not at all, so they need a key among the columns. Times without value come last.
    """
    rows = df
    for column, value in (filters or {}).items():
        if value is not None:
            rows = rows.where(F.col(quoted(column)) == value)
    rest = [c for c in df.columns if c != time]
    at = F.col(quoted(time))
    if after is not None:
        cursor = {c: _literal(after[c], df.schema[c].dataType) for c in df.columns}
        behind = F.struct(*[F.col(quoted(c)) for c in rest]) > F.struct(*[cursor[c].alias(c) for c in rest])
        if after[time] is None:
            rows = rows.where(at.isNull() & behind)
        else:
            # two scans with a plain filter each, which they can prune by
            older = rows.where(at <= cursor[time]).where((at < cursor[time]) | behind)
            rows = older.unionByName(rows.where(at.isNull()))
    return rows.orderBy(at.desc_nulls_last(), *[F.col(quoted(c)) for c in rest]).limit(limit)


def drift_summary(events: DataFrame) -> DataFrame:
    """Counts by type and severity."""
    return events.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("events"))


def drift_summary_line(events: DataFrame) -> DataFrame:
    """The same as one line of text, whose wording is a fixed value (there are three kinds of drift)."""
    counts = drift_summary(events)
    kinds = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("event_type", "events"))), lambda r: F.concat(r["events"].cast("string"), F.lit(" "), r["event_type"])), ", "
    )
    sums = counts.agg(
        kinds.alias("kinds"),
        F.sum(F.when(F.col("severity") == "breaking", F.col("events"))).alias("b"),
        F.sum(F.when(F.col("severity") == "additive", F.col("events"))).alias("a"),
    )
    parts = F.concat_ws(
        ", ",
        F.when(F.col("b") > 0, F.concat(F.col("b").cast("string"), F.lit(" breaking"))),
        F.when(F.col("a") > 0, F.concat(F.col("a").cast("string"), F.lit(" additive"))),
    )
    return sums.select(F.concat(F.lit("Schema drift detected: "), F.col("kinds"), F.lit(" ("), parts, F.lit(" changes)")).alias("summary"))


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The newest stored baseline of every table, of a history with ``created_at``."""
    order = Window.partitionBy("source", "table_name").orderBy(F.desc("created_at"))
    return baselines.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")
