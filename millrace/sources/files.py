"""Files of a folder: listing, reading by format, and the columns each one has.

A *unit* is what is loaded, replaced and deleted as a whole: one file, or one folder of part
files as Spark writes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import quoted
from millrace.sources import csv_records

# The extensions that are read, and their formats. Other files are skipped.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet"}


# Cells may hold line breaks and doubled quotes, and a cell that is not of its column's type fails the read.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}


def _extensions(fmt: str) -> str:
    return ",".join(e for e, f in FORMATS.items() if f == fmt)


def glob_of(pattern: str, fmt: str) -> str | None:
    """The part of a file pattern that one format may match, or None."""
    ending = pattern.rsplit(".", 1)[-1].lower()
    if ending in FORMATS:
        return pattern if FORMATS[ending] == fmt else None
    return f"{pattern}.{{{_extensions(fmt)}}}"


def decoded(path: Column) -> Column:
    """``_metadata.file_path`` is URL-encoded, where a plus is a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative(path: Column, folder: str, unit: str = "file") -> Column:
    """The path below ``folder``; for folder units without the name of the part file."""
    inside = F.substring_index(path, folder.rstrip("/") + "/", -1)
    return inside if unit == "file" else F.regexp_replace(inside, "/[^/]*$", "")


def list_files(spark: SparkSession, folder: str, pattern: str = "*", unit: str = "file") -> DataFrame:
    """Loadable units (file_path, file_size, file_mtime). Only the listing is read, no content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "modificationTime")
        .where(F.lower(F.substring_index("path", ".", -1)).isin(*FORMATS))
    )
    return files.groupBy(relative(F.col("path"), folder, unit).alias("file_path")).agg(
        F.sum("length").alias("file_size"), F.max("modificationTime").cast("timestamp_ntz").alias("file_mtime")
    )


def _reader(spark: SparkSession, fmt: str, glob: str | None):
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.options(**CSV)
    return reader.format(fmt)


def formats_in(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """The formats present (three at most)."""
    names = list_files(spark, folder, pattern).select(F.lower(F.substring_index("file_path", ".", -1)).alias("e")).distinct()
    return sorted({FORMATS[r["e"]] for r in names.collect()})


def infer_schema(
    spark: SparkSession,
    folder: str,
    pattern: str = "*",
    unit: str = "file",
    wanted: Sequence[str] | None = None,
    multiline: bool = False,
    headers: Sequence[dict] | None = None,
) -> T.StructType:
    """A one-off look at the files; store the result and pass it to later reads."""
    out = T.StructType()
    formats = formats_in(spark, folder, pattern) if wanted is None else list(dict.fromkeys(FORMATS.values()))
    for fmt in formats:
        glob, inputs = glob_of(pattern, fmt), unit_paths(folder, unit, fmt, wanted)
        if glob is None or not inputs:
            continue
        if fmt == "csv":
            for header in csv_headers(spark, inputs, pattern) if headers is None else headers:
                every = [literal(p) for p in header["paths"] + header["large"]]
                out = merge_schemas(out, _csv_reader(spark).option("inferSchema", True).load(every).schema, widen=True)
            continue
        reader = _reader(spark, fmt, glob)
        reader = reader.option("mergeSchema", True) if fmt == "parquet" else reader.option("multiLine", multiline)
        try:
            found = reader.load(inputs).schema
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            continue  # folders without a file of this format
        out = merge_schemas(out, found, widen=True)
    return out


def _csv_reader(spark: SparkSession):
    return spark.read.format("csv").options(**CSV)


def literal(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def unit_paths(folder: str, unit: str, fmt: str, wanted: Sequence[str] | None) -> list[str]:
    """What to read for one format: the folder, or the wanted units in it."""
    if wanted is None:
        return [folder]
    return [f"{folder.rstrip('/')}/{literal(w)}" for w in wanted if unit == "folder" or FORMATS.get(w.rsplit(".", 1)[-1].lower()) == fmt]


def scan_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    pattern: str = "*",
    provenance: bool = False,
    multiline: bool = False,
    uniform_csv: bool = False,
    unit: str = "file",
    wanted: Sequence[str] | None = None,
    headers: Sequence[dict] | None = None,
    split_from: int | None = None,
) -> DataFrame:
    """All CSV, JSON and parquet files of a folder as one table, matched by column name.

    CSV binds by position, so its files are grouped by header first (headers only are
    read); ``uniform_csv`` promises the order of ``schema`` and skips that look, and with it the parallel read. Quoted
    cells may hold line breaks: a file that fits one split is read by one task, a larger one (or one of more than
    ``split_from`` bytes) by many (``csv_records``), with the same rows. A cell that does not fit its type fails the read. Files without
    one of the columns give NULL. With ``provenance`` the file's path and time are added;
    ``wanted`` limits the read to some units, ``headers`` is ``csv_headers`` if known already.
    """
    parts = []
    origin = source_columns(folder, unit)
    for fmt in dict.fromkeys(FORMATS.values()):
        glob, inputs = glob_of(pattern, fmt), unit_paths(folder, unit, fmt, wanted)
        if glob is None or not inputs:
            continue
        if fmt == "csv" and not uniform_csv:
            for header in csv_headers(spark, inputs, pattern, split_from) if headers is None else headers:
                own = T.StructType([T.StructField(c, schema[c].dataType if c in schema.names else T.StringType()) for c in header["columns"]])
                if header["paths"]:
                    parts.append((_csv_reader(spark).schema(own).load([literal(p) for p in header["paths"]]), own.names, origin))
                if header["large"]:
                    places = _place(F.col("path"), F.col("mtime"), folder, unit)
                    rows = csv_records.read(spark, [literal(p) for p in header["large"]], own, CSV, *places)
                    parts.append((rows, own.names, [F.col(n) for n in SOURCE_COLUMNS]))
            continue
        reader = _reader(spark, fmt, glob).schema(schema)
        if fmt == "json" and multiline:
            reader = reader.option("multiLine", True)
        parts.append((reader.load(inputs), schema.names, origin))
    out = None
    for df, names, added in parts:
        columns = [(F.col(quoted(f.name)) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
        if provenance:
            columns += added
        part = df.select(*columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


SOURCE_COLUMNS = ("_src_file", "_src_mtime")


def _place(path: Column, mtime: Column, folder: str, unit: str) -> list[Column]:
    values = relative(decoded(path), folder, unit), mtime.cast("timestamp_ntz")
    return [v.alias(n) for v, n in zip(values, SOURCE_COLUMNS, strict=True)]


def source_columns(folder: str, unit: str = "file") -> list[Column]:
    return _place(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time"), folder, unit)


def tag_provenance(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Add file name, file time, load time and a deleted mark to rows read from files."""
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("_src_file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("_src_mtime"),
        (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("_src_loaded_at"),
        F.lit(False).alias("_src_deleted"),
    )


# --- columns per file -------------------------------------------------------------------


def _open(path: str):
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", path)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    system, inner = fs.FileSystem.from_uri(quote(uri, safe=":/@=+,%"))
    return system, inner


def _columns_of(path: str) -> list[str]:
    """Column names of one CSV or parquet file, from its first record or its footer."""
    import csv
    import io

    from pyarrow import parquet

    system, inner = _open(path)
    if path.lower().endswith(".parquet"):
        with system.open_input_file(inner) as file:
            return list(parquet.read_schema(file).names)
    with system.open_input_stream(inner) as file:
        # a quoted name may hold line breaks, so the parser decides where the first record ends
        return next(csv.reader(io.TextIOWrapper(file, "utf-8-sig", newline="")), [])


def _read_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(columns=[_columns_of(p) for p in batch["path"]])


def _heads(spark: SparkSession, inputs: Sequence[str], glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    files = reader.load(list(inputs)).select("path", "length")
    return files.mapInPandas(_read_columns, "path string, length bigint, columns array<string>")


def _split_bytes(spark: SparkSession) -> int:
    """The size beyond which Spark splits a file."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def csv_headers(spark: SparkSession, inputs: Sequence[str], pattern: str = "*", split_from: int | None = None) -> list[dict]:
    """The distinct CSV headers of a folder, each with the files that have it: the list of files a read needs.

    ``large`` are those that one task should not read alone, ``paths`` the others. A row is one file, not one header,
    and the driver groups them.
    """
    glob = glob_of(pattern, "csv")
    if glob is None:
        return []
    most = _split_bytes(spark) if split_from is None else split_from
    heads = _heads(spark, inputs, glob).where(F.size("columns") > 0).select("path", "columns", (F.col("length") > most).alias("large"))
    found: dict[tuple, dict] = {}
    for row in heads.toLocalIterator():
        header = found.setdefault(tuple(row["columns"]), {"columns": list(row["columns"]), "paths": [], "large": []})
        header["large" if row["large"] else "paths"].append(row["path"])
    return list(found.values())


def file_columns(
    spark: SparkSession,
    folder: str,
    pattern: str = "*",
    unit: str = "file",
    wanted: Sequence[str] | None = None,
    multiline: bool = False,
    formats: Sequence[str] = ("csv", "json", "parquet"),
) -> DataFrame:
    """Sorted column names of every unit: (file_path, columns).

    CSV headers and parquet footers are read by the executors; JSON lines are parsed for the
    keys of every row, whose distinct names combine map-side. ``multiline`` JSON files hold one
    array or object each and are read whole.
    """
    parts = []
    for fmt in formats:
        glob, inputs = glob_of(pattern, fmt), unit_paths(folder, unit, fmt, wanted)
        if glob is None or not inputs:
            continue
        if fmt == "json":
            lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(inputs, wholetext=multiline)
            path, names = decoded(F.col("_metadata.file_path")), F.json_object_keys("value")
            if multiline:
                listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
                objects = lines.select(path.alias("path"), F.explode(F.from_json(listed, "array<variant>")).alias("_v"))
                lines, path, names = objects, F.col("path"), F.json_object_keys(F.to_json("_v"))
        else:
            lines = _heads(spark, inputs, glob)
            path, names = F.col("path"), F.col("columns")
        parts.append(lines.select(relative(path, folder, unit).alias("file_path"), F.explode(names).alias("column_name")))
    if not parts:
        return spark.createDataFrame([], "file_path string, columns array<string>")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # Two steps: distinct names combine before the shuffle, and a unit's list is as long as its header.
    names = every.groupBy("file_path", "column_name").agg(F.lit(1).alias("_one"))
    return names.groupBy("file_path").agg(F.array_sort(F.collect_list("column_name")).alias("columns"))


def validate_file_schemas(columns: DataFrame, expected: Sequence[str] | None = None, metadata: Sequence[str] = ("_src_",)) -> DataFrame:
    """Units whose set of columns differs from the table's, or from the first unit's.

    ``columns`` is ``file_columns``. No row means that all may be loaded; the caller loads
    nothing otherwise.
    """
    if expected is None:
        want = columns.agg(F.min_by("columns", "file_path")).scalar()
    else:
        plain = [c for c in expected if not c.startswith(tuple(metadata))]
        want = F.array(*[F.lit(c) for c in plain]).cast("array<string>")
    checked = columns.withColumn("_want", want).select(
        "file_path",
        F.array_sort(F.array_except("columns", "_want")).alias("extra"),
        F.array_sort(F.array_except("_want", "columns")).alias("missing"),
    )
    return checked.where((F.size("extra") > 0) | (F.size("missing") > 0))


# --- schema evolution -------------------------------------------------------------------


#: Whole numbers in order of their width.
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The numeric type that holds the values of both; None if there is none."""
    if a == b:
        return a
    if isinstance(a, WHOLE) and isinstance(b, WHOLE):
        return max(a, b, key=lambda x: WHOLE.index(type(x)))
    if all(isinstance(x, (*WHOLE, T.FloatType, T.DoubleType)) for x in (a, b)):
        return T.DoubleType()
    return None


def merge_schemas(known: T.StructType, incoming: T.StructType, widen: bool = False) -> T.StructType:
    """The known columns, then the new ones with their types.

    A changed type is an error; with ``widen`` a column of numbers takes the type that holds both.
    """
    out = {f.name: f for f in known.fields}
    for field in incoming.fields:
        old = out.get(field.name)
        if old is None:
            out[field.name] = T.StructField(field.name, field.dataType, True)
            continue
        both = wider(old.dataType, field.dataType) if widen else None
        if both is None and old.dataType != field.dataType:
            raise ValueError(f"column {field.name} is {old.dataType.simpleString()}, the file has {field.dataType.simpleString()}")
        out[field.name] = T.StructField(field.name, both or old.dataType, old.nullable)
    return T.StructType(list(out.values()))


def evolve_schema(table: DataFrame, incoming: DataFrame, opt_in: bool = True) -> DataFrame:
    """Rows of both with the union of their columns, NULL where one lacks a column; numbers take the wider type."""
    if not opt_in and set(table.columns) != set(incoming.columns):
        raise ValueError(f"columns differ: {sorted(set(table.columns) ^ set(incoming.columns))}")
    grown = merge_schemas(table.schema, incoming.schema, widen=True)
    both = table.unionByName(incoming, allowMissingColumns=True)
    return both.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in grown.fields])


# --- SQL databases ----------------------------------------------------------------------


def scan_sql_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    partition: tuple[str, int, int, int] | None = None,
    fmt: str = "jdbc",
) -> DataFrame:
    """A full snapshot of a database table.

    ``partition`` is (column, lower, upper, parts) for a parallel read. Filters and columns
    are pushed to the database by the source.
    """
    reader = spark.read.format(fmt)
    if fmt != "jdbc":
        return reader.load(f"{url.rstrip('/')}/{table}")
    reader = reader.option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition is not None:
        column, low, high, parts = partition
        reader = (
            reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        )
    return reader.load()


def snapshot_ranges(rows: DataFrame, key: str, parts: int, accuracy: int = 100) -> list[str]:
    """Predicates that cut a table into about ``parts`` ranges of equal depth, and one for rows without key.

    The bounds are quantiles of the key from one mergeable sketch, so a skewed key gives ranges of different width and like
    numbers of rows: the error of a rank is ``1 / (accuracy * parts)``. A single value that is more common than a share
    cannot be cut and stays in one range. The predicates are plain SQL, so a database evaluates them. The key is a number, a date or a time.
    """
    kind = rows.schema[key].dataType
    name = quoted(key)
    cuts = F.percentile_approx(name, [k / parts for k in range(1, parts)], accuracy * parts) if parts > 1 else F.array().cast(T.ArrayType(kind))
    found = rows.agg(F.transform(F.array_sort(F.array_distinct(cuts)), lambda v: v.cast("string"))).first()[0] or []
    literal_ = (lambda v: f"{kind.simpleString().split('_')[0].upper()} '{v}'") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else str
    bounds = [literal_(v) for v in found]
    if not bounds:
        return [f"{name} IS NOT NULL", f"{name} IS NULL"]
    inner = [f"{name} >= {a} AND {name} < {b}" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [f"{name} < {bounds[0]}", *inner, f"{name} >= {bounds[-1]}", f"{name} IS NULL"]


def scan_ranges(
    spark: SparkSession, url: str, table: str, key: str, parts: int, properties: dict[str, str] | None = None, fmt: str = "jdbc"
) -> DataFrame:
    """A snapshot of a database table by ranges of equal depth, each read by a task of its own.

    ``scan_sql_table`` with given bounds splits their span evenly, so a skewed key leaves most rows to few tasks.
    """
    whole = scan_sql_table(spark, url, table, properties, fmt=fmt)
    predicates = snapshot_ranges(whole.select(quoted(key)), key, parts)
    if fmt == "jdbc":
        quote = lambda p: p.replace("`", '"')
        return spark.read.jdbc(url, table, predicates=[quote(p) for p in predicates], properties=properties or {})
    out = None
    for predicate in predicates:
        part = whole.where(predicate)
        out = part if out is None else out.unionByName(part)
    return out


def scan_sql_tables(spark: SparkSession, url: str, tables: Sequence[str], **options) -> dict[str, DataFrame]:
    return {name: scan_sql_table(spark, url, name, **options) for name in tables}
