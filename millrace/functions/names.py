"""Column and table names: normalisation and the families of types and internal names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Name prefixes of bookkeeping columns and tables. Callers may pass their own.
INTERNAL_PREFIXES = ("_load_", "_src_")
# Bookkeeping tables of spreadsheet sources, never profiled or staged.
BOOKKEEPING_TABLES = ("spreadsheet", "spreadsheet_info")

NUMERIC = (T.NumericType,)
TEXT = (T.StringType, T.CharType, T.VarcharType)


def is_internal(name: str, prefixes: Sequence[str] = INTERNAL_PREFIXES) -> bool:
    return name.lower().startswith(tuple(p.lower() for p in prefixes))


def user_columns(df: DataFrame, prefixes: Sequence[str] = INTERNAL_PREFIXES) -> list[T.StructField]:
    return [f for f in df.schema.fields if not is_internal(f.name, prefixes)]


def user_tables(names: Iterable[str], prefixes: Sequence[str] = INTERNAL_PREFIXES) -> list[str]:
    return [n for n in names if not is_internal(n, prefixes) and n not in BOOKKEEPING_TABLES]


def normalize_name(name: str) -> str:
    """Lower case, every run of other characters one underscore."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", name.lower())).strip("_")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def first_line(error: Exception) -> str:
    """What an error says, in one line; its kind if it says nothing."""
    return (str(error).strip() or type(error).__name__).splitlines()[0]
