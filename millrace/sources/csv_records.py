"""Large CSV files with quoted line breaks, read by many tasks.

A line break ends a record unless it stands in a quoted cell, and whether it does depends on all that comes before
it. So a file is read in its splits, as lines, twice:

1. Every split tells how it would end if it began outside of a quoted cell, and if it began inside one: a map of two
   states. The maps of a file's splits are composed in order (a prefix scan over as many rows as there are splits), which
   gives the state in which each split really begins.
2. Every split joins its lines to records. What belongs to a record of an earlier split, at its front, and its own last
   record, if that is still open, are fragments: two a split at most, joined by file and running number.

The records go to Spark's own CSV parser. The driver holds the splits that begin inside a cell, of those that Spark plans
there anyway.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, DELIMITER = '"', ","

#: What a row of the second pass is: a record, the front part of a split, its open last record.
WHOLE, FRONT, OPEN = 0, 1, 2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the line break after ``line`` is in a quoted cell, if the one before it is (``inside``) or is not.

    Only a quote at the start of a cell opens it. It ends at a quote before a separator or the end of the line; two
    quotes are one character; a single quote within makes the rest of the cell plain text.
    """
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != QUOTE:
                at = line.find(DELIMITER, at) + 1
                if not at:
                    return False
                continue
            at += 1
        inside = False
        while True:
            at = line.find(QUOTE, at) + 1
            if not at:
                return True
            if line[at : at + 1] != QUOTE:
                break
            at += 1
        if line[at : at + 1] != DELIMITER:
            # the end of the line, or a stray quote
            at = line.find(DELIMITER, at)
            if at < 0:
                return False
        at += 1


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, mtime, start, value``: the lines of all splits, in order within each."""
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    meta = {"path": "file_path", "mtime": "file_modification_time", "start": "file_block_start"}
    return rows.select(*[F.col(f"_metadata.{old}").alias(new) for new, old in meta.items()], "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Cut a batch where another split begins."""
    n = batch.num_rows
    if not n:
        return
    ids = batch.column("path").dictionary_encode().indices.to_numpy(), batch.column("start").to_numpy()
    edges = [0, *[k for k in range(1, n) if any(x[k] != x[k - 1] for x in ids)], n] if any((x != x[0]).any() for x in ids) else [0, n]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.column("path")[a].as_py(), batch.column("start")[a].as_py(), batch.slice(a, b - a)


def split_states(lines: DataFrame) -> DataFrame:
    """``path, start, if_out, if_in``: whether a split ends inside a cell, by how it begins."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[bool, bool]] = {}
        for batch in batches:
            for path, start, part in _runs(batch):
                out, in_ = ends.get((path, start), (False, True))
                values = part.column("value")
                for line in values.filter(pc.match_substring(values, QUOTE)).to_pylist():
                    out, in_ = ends_inside(line, out), ends_inside(line, in_)
                ends[path, start] = out, in_
        if ends:
            yield pa.RecordBatch.from_pylist(
                [{"path": p, "start": s, "if_out": o, "if_in": i} for (p, s), (o, i) in ends.items()],
                pa.schema([("path", pa.string()), ("start", pa.int64()), ("if_out", pa.bool_()), ("if_in", pa.bool_())]),
            )

    return lines.select("path", "start", "value").mapInArrow(scan, "path string, start bigint, if_out boolean, if_in boolean")


def begun_inside(states: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside a quoted cell. A file's list has an entry for each of its splits."""
    listed = states.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "if_out", "if_in"))).alias("splits"))
    step = lambda acc, s: F.struct(
        F.when(acc["inside"], s["if_in"]).otherwise(s["if_out"]).alias("inside"),
        F.when(acc["inside"], F.concat(acc["found"], F.array(s["start"]))).otherwise(acc["found"]).alias("found"),
    )
    first = F.struct(F.lit(False).alias("inside"), F.array().cast("array<bigint>").alias("found"))
    found = listed.select("path", F.explode(F.aggregate("splits", first, step)["found"]).alias("start"))
    return {(r["path"], r["start"]) for r in found.collect()}


def records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, mtime, start, nth, value``: all records of the files, the header too, with their quoted line breaks.

    ``start`` and ``nth`` are the split and the place in it where a record begins.
    """
    lines = _lines(spark, paths)
    inside = begun_inside(split_states(lines))

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        kind, held, nth, mtime = WHOLE, [], 0, None

        def row(what: int, value: str) -> dict:
            return {"path": now[0], "mtime": mtime, "start": now[1], "nth": nth, "kind": what, "value": value}

        schema = pa.schema(
            [
                ("path", pa.string()),
                ("mtime", pa.timestamp("us", "UTC")),
                ("start", pa.int64()),
                ("nth", pa.int64()),
                ("kind", pa.int32()),
                ("value", pa.string()),
            ]
        )
        for batch in batches:
            rows: list[dict] = []
            for path, start, part in _runs(batch):
                if now != (path, start):
                    if held:
                        rows.append(row(FRONT if kind == FRONT else OPEN, "\n".join(held)))
                    now, held, nth, mtime = (path, start), [], 0, part.column("mtime")[0].as_py()
                    kind = FRONT if now in inside else WHOLE
                    open_ = now in inside
                values = part.column("value")
                for line, quoted in zip(values.to_pylist(), pc.match_substring(values, QUOTE).to_pylist(), strict=True):
                    if quoted:
                        open_ = ends_inside(line, open_)
                    held.append(line)
                    if not open_:
                        rows.append(row(kind, "\n".join(held)))
                        kind, held, nth = WHOLE, [], nth + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row(FRONT if kind == FRONT else OPEN, "\n".join(held))], schema)

    found = lines.mapInArrow(assemble, "path string, mtime timestamp, start bigint, nth bigint, kind int, value string")
    whole = found.where(F.col("kind") == WHOLE).drop("kind")
    # an open record, and the fronts of the splits behind it: at most two rows a split
    order = W.partitionBy("path").orderBy("start", "nth").rowsBetween(W.unboundedPreceding, 0)
    pieces = found.where(F.col("kind") != WHOLE).withColumn("record", F.count_if(F.col("kind") == OPEN).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "nth", "value")))
    first = F.min(F.struct("start", "nth"))
    joined = pieces.groupBy("path", "record").agg(F.min("mtime").alias("mtime"), first.alias("first"), parts.alias("parts"))
    stitched = joined.select("path", "mtime", "first.start", "first.nth", F.array_join("parts.value", "\n").alias("value"))
    return whole.unionByName(stitched)


def read(spark: SparkSession, paths: Sequence[str], schema: T.StructType, options: dict, *extra: Column) -> DataFrame:
    """The rows of CSV files that have a header, parsed by Spark; ``extra`` are columns made from ``path`` and ``mtime``.

    As in a read of whole files, line breaks of files that end lines with CR LF become LF, and empty lines are skipped.
    """
    found = records(spark, paths)
    ends = F.substring("value", -1, 1) == "\r"
    header = (F.col("start") == 0) & (F.col("nth") == 0)
    crlf = found.where(header & ends).select("path").distinct().withColumn("crlf", F.lit(True))
    # one row a file at most, of those whose paths the driver holds
    rows = found.where(~header).join(F.broadcast(crlf), "path", "left")
    value = F.regexp_replace(F.col("value"), "\r$", "")
    value = F.when(F.col("crlf"), F.replace(value, F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("value"))
    rows = rows.withColumn("value", value).where("value <> ''")
    parse = {k: str(v) for k, v in options.items() if k not in ("header", "multiLine")}
    ddl = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema.fields))
    parsed = rows.withColumn("row", F.from_csv("value", ddl, parse))
    return parsed.select(*[F.col(f"row.c{k}").alias(f.name) for k, f in enumerate(schema.fields)], *extra)
