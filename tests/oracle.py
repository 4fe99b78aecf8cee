"""Compare a registered query with its SQL: same columns, types and rows."""

from __future__ import annotations

import math
import pathlib

import duckdb
import pyarrow as pa


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp" + ("tz" if t.tz else "")
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{_kind(t.value_type)}>"
    return str(t)


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return repr(value)


def normalize(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    kinds = [(n, _kind(table.schema.field(n).type)) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(tuple(_cell(v) for v in row) for row in zip(*columns, strict=True))
    return kinds, rows


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """None when equal, else a short description."""
    kinds, rows = normalize(spark_table)
    want_kinds, want = normalize(sql_table)
    problems = []
    if kinds != want_kinds:
        problems.append(f"schema {set(kinds) ^ set(want_kinds)}")
    if len(rows) != len(want):
        problems.append(f"rows {len(rows)} != {len(want)}")
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:2]
        missing = [r for r in want if r not in set(rows)][:2]
        problems.append(f"values: ours {extra} theirs {missing}")
    return "; ".join(problems) or None
