"""Text to numbers at scale.

``try_cast`` of text that is no number raises and catches an exception per row, some ten
microseconds each. Testing the form first keeps columns with many such values fast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_long(text: Column) -> Column:
    """A whole number, NULL for other text and beyond 64 bits."""
    return F.when(text.rlike(WHOLE), text).try_cast("bigint")


def to_double(text: Column) -> Column:
    """A number with or without a fraction or exponent, NULL for other text."""
    return F.when(text.rlike(DECIMAL), text).try_cast("double")
