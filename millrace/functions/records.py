"""Reshaping of source records: nested to flat, lists to rows, ids to labels.

All are column expressions or explodes of one row's own values; none shuffles, except where a
function joins or removes duplicates and says so.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.casts import WHOLE, to_double, to_long
from millrace.functions.names import normalize_name, quoted
from millrace.operators.dedup import first_row
from millrace.operators.load import without_keys, write_merge

# Metrics of advertising reports that are whole numbers, and those that are fractions.
INTEGER_METRICS = (
    "impressions", "clicks", "video_views", "interactions", "gmail_forwards", "gmail_saves", "gmail_secondary_clicks",
)
FLOAT_METRICS = (
    "conversions", "conversions_value", "cost_per_conversion", "ctr", "average_cpc", "average_cpm", "average_cpv",
    "search_impression_share", "search_rank_lost_impression_share", "search_budget_lost_impression_share",
    "search_top_impression_percentage", "search_absolute_top_impression_percentage", "interaction_rate", "average_cost",
)
MICROS = 1_000_000
# Key parts of advertising insights, and the prefix of stage entry times.
INSIGHT_KEYS = ("campaign_id", "adset_id", "ad_id", "date_start")
STAGE_PREFIX = "hs_v2_date_entered_"


# --- spreadsheets -----------------------------------------------------------------------


def sheet_rows_clean(df: DataFrame, values: str, headers: Sequence[str | None], keep: Sequence[str] = ()) -> DataFrame:
    """Cells under their headers: empty rows go, empty cells are NULL, short rows are padded,
    and cells without a header are dropped."""
    cells = [F.nullif(F.get(F.col(quoted(values)), F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(headers) if h]
    return df.where(F.size(quoted(values)) > 0).select(*[quoted(k) for k in keep], *cells)


def range_status(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """Which named ranges are skipped: without rows, with a header only, or with a blank first row.

    ``ranges``: range_name. ``rows``: range_name, row_no, values. Aggregates; no range is
    gathered in one place.
    """
    facts = rows.groupBy("range_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.min_by(F.size("values"), "row_no").alias("_first")
    )
    joined = ranges.join(facts, "range_name", "left")
    n = F.coalesce("row_count", F.lit(0))
    reason = F.when(n == 0, "empty").when(n == 1, "header_only").when(F.col("_first") == 0, "blank_first_row")
    return joined.select("range_name", n.alias("row_count"), reason.isNotNull().alias("skipped"), reason.alias("reason"))


# --- nested records ---------------------------------------------------------------------


def _leaves(dtype: T.StructType, path: Column, prefix: str) -> list[Column]:
    out = []
    for f in dtype.fields:
        inner, name = path.getField(f.name), f"{prefix}_{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, inner, name)
        else:
            out.append(inner.alias(name))
    return out


def flatten_struct(df: DataFrame, segments: str = "segments", metrics: str = "metrics") -> DataFrame:
    """Flat columns of a nested report row.

    Segments keep their names (a ``date`` becomes a date), metrics get their types and micros
    become units, other structs are joined to their path by underscores.
    """
    out: list[Column] = []
    for f in df.schema.fields:
        col = F.col(quoted(f.name))
        if not isinstance(f.dataType, T.StructType):
            out.append(col)
        elif f.name == segments:
            out += [(F.to_date(col.getField(s.name)) if s.name == "date" else col.getField(s.name)).alias(s.name) for s in f.dataType.fields]
        elif f.name == metrics:
            out += [_metric(col.getField(m.name), m.name) for m in f.dataType.fields]
        else:
            out += _leaves(f.dataType, col, f.name)
    return df.select(*out)


def _metric(value: Column, name: str) -> Column:
    if name == "cost_micros":
        return F.coalesce(to_double(value.cast("string")) / MICROS, F.lit(0.0)).alias("cost")
    if name in INTEGER_METRICS:
        return to_long(value.cast("string")).alias(name)
    if name in FLOAT_METRICS:
        return to_double(value.cast("string")).alias(name)
    return value.alias(name)


def hoist_properties(df: DataFrame, associations: Sequence[str] = (), context: Mapping[str, object] | None = None) -> DataFrame:
    """Nested ``properties`` as columns, with the row's id, its associations and a context.

    An association becomes the distinct list of (value, <name>_id).
    """
    names = [f.name for f in df.schema["properties"].dataType.fields]
    out = [F.col("properties").getField(n).alias(n) for n in names]
    if "id" not in names:
        out.append(F.col("id"))
    for name in associations:
        results = F.col("associations").getField(name).getField("results")
        out.append(F.array_distinct(F.transform(results, _pair(F.col("properties").getField("hs_object_id"), name))).alias(name))
    out += [F.lit(v).alias(k) for k, v in (context or {}).items()]
    return df.select(*out)


def _pair(key: Column, name: str) -> Callable[[Column], Column]:
    return lambda result: F.struct(key.alias("value"), result["id"].alias(f"{name}_id"))


def associations_explode(df: DataFrame, association: str, key: str = "hs_object_id", results: str = "results") -> DataFrame:
    """Pairs (value, <association>_id)."""
    return df.select(F.col(quoted(key)).alias("value"), F.explode(quoted(results)).alias("_r")).select(
        "value", F.col("_r.id").alias(f"{association}_id")
    )


def property_history_explode(df: DataFrame, history: str = "propertiesWithHistory") -> DataFrame:
    """One row per entry of every property's history; objects without history give none."""
    by_property = df.select(F.col("id").alias("object_id"), F.explode(quoted(history)).alias("property_name", "_entries"))
    return by_property.select("object_id", "property_name", F.inline("_entries"))


def nested_totals(df: DataFrame) -> DataFrame:
    """``nodes`` and ``totalCount`` of connections lifted: of reactions, comments, and the
    reactions of every comment."""
    comment = df.schema["comments"].dataType["nodes"].dataType.elementType

    def lifted(node: Column) -> Column:
        fields = [node[f.name].alias(f.name) for f in comment.fields if f.name != "reactions"]
        if "reactions" in comment.names:
            fields += [
                node["reactions"]["nodes"].alias("reactions"),
                F.coalesce(node["reactions"]["totalCount"], F.lit(0)).alias("reactions_totalCount"),
            ]
        return F.struct(*fields)

    others = [quoted(c) for c in df.columns if c not in ("reactions", "comments")]
    return df.select(
        *others,
        F.col("reactions.nodes").alias("reactions"),
        F.coalesce("reactions.totalCount", F.lit(0)).alias("reactions_totalCount"),
        F.transform("comments.nodes", lifted).alias("comments"),
        F.coalesce("comments.totalCount", F.lit(0)).alias("comments_totalCount"),
    )


def child_table_name(parent: str, child: str) -> str:
    return "__".join(normalize_name(part) for part in [*parent.split("__"), child])


def normalize_nested(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """A list column as a child table: the parent's key, the position, and the element's fields."""
    element = df.schema[column].dataType.elementType
    rows = df.select(*[F.col(quoted(k)).alias(f"parent_{k}") for k in keys], F.posexplode(quoted(column)).alias("list_idx", "_e"))
    if isinstance(element, T.StructType):
        return rows.select(*[c for c in rows.columns if c != "_e"], "_e.*")
    return rows.withColumnRenamed("_e", "value")


def split_nested(df: DataFrame, table: str, keys: Sequence[str], max_depth: int | None = None) -> dict[str, DataFrame]:
    """All child tables of a nested table, by name, with the flat parent.

    Lists below ``max_depth`` levels stay in their child as JSON text; without it every level becomes a table.
    """
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if max_depth == 0:
        return {table: df.withColumns({name: F.to_json(quoted(name)) for name in lists})}
    out = {table: df.drop(*lists)}
    for name in lists:
        child = normalize_nested(df, name, keys)
        child_keys = [*[f"parent_{k}" for k in keys], "list_idx"]
        out |= split_nested(child, child_table_name(table, name), child_keys, None if max_depth is None else max_depth - 1)
    return out


# --- labels for ids ---------------------------------------------------------------------


@dataclass(frozen=True)
class FieldLabels:
    """A custom field: its key in the records, its name, its kind and the labels of its options."""

    key: str
    name: str
    kind: str
    options: Mapping[str, str] = field(default_factory=dict)


def _label(options: Mapping[str, str], option: Column) -> Column:
    if not options:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(v) for pair in options.items() for v in pair])
    return F.try_element_at(table, option)


def _label_or_id(options: Mapping[str, str]) -> Callable[[Column], Column]:
    return lambda option: F.coalesce(_label(options, option.cast("string")), option.cast("string"))


def _last_value(entries: Column, key_field: str, key: str) -> Column:
    """The value of the last entry with a key, NULL without one."""
    mine = F.filter(entries, lambda entry: entry[key_field].cast("string") == F.lit(key))
    return F.try_element_at(mine, F.lit(-1))["value"]


def enum_relabel(df: DataFrame, fields: Sequence[FieldLabels]) -> DataFrame:
    """Custom fields under their names, option ids (one, or a list of them) as labels.

    An id without a label stays. The labels are part of the configuration and travel in the plan.
    """
    out: list[Column] = []
    by_key = {f.key: f for f in fields}
    for name in df.columns:
        known = by_key.get(name)
        col = F.col(quoted(name))
        if known is None:
            out.append(col)
        elif known.kind == "set":
            out.append(F.transform(col, _label_or_id(known.options)).alias(known.name))
        elif known.kind == "enum":
            out.append(_label_or_id(known.options)(col).alias(known.name))
        else:
            out.append(col.alias(known.name))
    return df.select(*out)


def field_mapping_merge(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Field labels (key, name, option_id, label) after a load: the first name of a field and
    the first label of an option stay, only new options come."""
    added = without_keys(first_row(fresh, ["key", "option_id"], []), known, ["key", "option_id"])
    names = known.select("key", F.col("name").alias("_first")).groupBy("key").agg(F.min("_first").alias("_first"))
    named = added.join(names, "key", "left").withColumn("name", F.coalesce("_first", "name")).select(*known.columns)
    return known.unionByName(named)


def custom_field_pivot(df: DataFrame, fields: Sequence[FieldLabels], column: str = "custom_fields") -> DataFrame:
    """Custom fields (an array of id and value) as columns named by their titles.

    Options become labels: an unknown single option is NULL, an unknown one in a list (JSON
    text, kind ``set``) stays as it is. Fields that are not known remain in the array.
    """
    entries = F.col(quoted(column))
    out: list[Column] = [F.col(quoted(c)) for c in df.columns if c != column]
    for f in fields:
        value = _last_value(entries, "id", f.key)
        if f.kind == "set":
            out.append(F.transform(F.from_json(value, "array<string>"), _label_or_id(f.options)).alias(f.name))
        elif f.options:
            out.append(F.when(value != "", _label(f.options, value)).otherwise(value).alias(f.name))
        else:
            out.append(value.alias(f.name))
    keys = [f.key for f in fields]
    out.append(F.filter(entries, lambda e: ~e["id"].cast("string").isin(*keys)).alias(column))
    return df.select(*out)


# --- lists and maps to rows and columns -------------------------------------------------


def stage_unpivot(df: DataFrame, key: str = "id", prefix: str = STAGE_PREFIX) -> DataFrame:
    """Columns ``<prefix><stage>`` as rows (key, time under the prefix's name, stage); rows
    without a key and stages without a time are left out."""
    stages = [c for c in df.columns if c.startswith(prefix)]
    pairs = F.array(*[F.struct(F.col(quoted(c)).alias(prefix), F.lit(c.removeprefix(prefix)).alias("stage")) for c in stages])
    rows = df.where(F.col(quoted(key)).isNotNull()).select(quoted(key), F.inline(pairs))
    return rows.where(F.col(quoted(prefix)).isNotNull())


def report_explode_by_date(df: DataFrame, column: str, row_schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """A JSON report ``{date: [rows]}`` or ``{date: row}`` as rows with their date."""
    spark = df.sparkSession
    parsed = df.select(*[quoted(k) for k in keep], F.try_parse_json(quoted(column)).alias("_json"))
    days = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_json").outer()))
    row = f"struct<{row_schema}>"
    several = F.try_variant_get("value", "$", f"array<{row}>")
    one = F.try_variant_get("value", "$", row)
    rows = F.coalesce(several, F.when(one.isNotNull(), F.array(one)))
    return days.select(*[quoted(k) for k in keep], F.to_date("key").alias("date"), F.inline(rows))


def attribute_pivot(df: DataFrame, attributes: Mapping[str, str], column: str = "attributes") -> DataFrame:
    """An array of (attribute_id, data_type, value) as columns; values of type date as dates."""
    entries = F.col(quoted(column))
    out: list[Column] = [F.col(quoted(c)) for c in df.columns if c != column]
    for name, kind in attributes.items():
        value = _last_value(entries, "attribute_id", name)
        out.append((F.to_date(F.try_to_timestamp(F.nullif(value, F.lit("")))) if kind == "date" else value).alias(name))
    return df.select(*out)


# --- keys -------------------------------------------------------------------------------


def sentinel_keys(df: DataFrame, keys: Sequence[str] = INSIGHT_KEYS) -> DataFrame:
    """Missing key parts as ``no_<name>``, so that a merge by them works."""
    have = set(df.columns)
    return df.withColumns({k: F.coalesce(F.col(quoted(k)).cast("string"), F.lit(f"no_{k}")) if k in have else F.lit(f"no_{k}") for k in keys})


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_content(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row per content, the first by ``order``; the shuffle compares digests.

    The bound on row_number reaches the map side, so copies combine before the shuffle.
    """
    hashed = df.withColumn("content_hash", content_hash(F.col(quoted(column))))
    return first_row(hashed, ["content_hash"], [F.col(quoted(c)) for c in order])


def message_id(*parts: Column) -> Column:
    """Digest of what identifies a message: each part behind its length, so parts cannot run together. NULL counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(*[F.concat(F.char_length(x).cast("string"), F.lit(":"), x) for x in texts]), 256)


def distinct_visitors(visits: DataFrame, known: DataFrame, key: str, latest_by: str) -> DataFrame:
    """Known visitors, updated and extended by those of new visits."""
    return write_merge(known, visits.select(*known.columns), [key], [latest_by])


def parse_cursor_json(column: Column, path: str) -> Column:
    """The value at a path of a JSON text, such as the next page's cursor."""
    return F.nullif(F.get_json_object(column, path), F.lit(""))


# Extended JSON of document databases: the wrappers of values plain JSON has no type for.
EXTENDED = (
    "struct<`$oid`: string, `$numberDecimal`: string, `$numberLong`: string, `$date`: string, "
    "`$timestamp`: struct<t: bigint, i: bigint>, `$regularExpression`: struct<pattern: string, options: string>>"
)


def bson_normalize(column: Column) -> Column:
    """An extended-JSON value as text: ids and decimals as they are, times in ISO form, the
    pattern of an expression; anything else unchanged."""
    wrapped = F.from_json(column, EXTENDED)
    stamp = F.date_format(F.timestamp_seconds(wrapped["$timestamp"]["t"]), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = wrapped["$date"]
    when = F.date_format(F.when(day.rlike(WHOLE), F.timestamp_millis(to_long(day))).otherwise(F.try_to_timestamp(day)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    unwrapped = F.coalesce(
        wrapped["$oid"], wrapped["$numberDecimal"], wrapped["$numberLong"], when, stamp, wrapped["$regularExpression"]["pattern"]
    )
    return F.when(column.startswith("{"), F.coalesce(unwrapped, column)).otherwise(column)


def bson_timestamp(column: Column) -> Column:
    """The time in an extended-JSON ``$timestamp`` or ``$date`` as a timestamp; NULL for anything else."""
    wrapped = F.from_json(column, EXTENDED)
    day = wrapped["$date"]
    when = F.when(day.rlike(WHOLE), F.timestamp_millis(to_long(day))).otherwise(F.try_to_timestamp(day))
    return F.coalesce(when, F.timestamp_seconds(wrapped["$timestamp"]["t"])).cast("timestamp_ntz")
