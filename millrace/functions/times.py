"""Times and typed values out of the forms sources send them in.

Results are timestamps without zone, in UTC, computed without the session's time zone where
the input has none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.casts import WHOLE, to_double, to_long
from millrace.functions.names import quoted

# Day 0 of spreadsheet serial numbers, and the bound above which an epoch is in ms.
SERIAL_EPOCH = "1899-12-30"
SECONDS_PER_DAY = 86_400
MILLIS_ABOVE = 1e10

# Report dimensions and the formats of their values.
DIMENSION_FORMATS = {
    "date": "yyyyMMdd",
    "dateHour": "yyyyMMddHH",
    "dateHourMinute": "yyyyMMddHHmm",
    "yearMonth": "yyyyMM",
    "year": "yyyy",
}
ISO_WEEK = "isoYearIsoWeek"


def after(epoch: str, seconds: Column) -> Column:
    """A number of seconds (with fractions) after a moment."""
    return F.lit(epoch).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def serial_to_timestamp(serial: Column) -> Column:
    """Spreadsheet days since 1899-12-30 as a time, to the second."""
    return after(SERIAL_EPOCH, F.round(serial.cast("double") * SECONDS_PER_DAY))


def serial_to_date(serial: Column) -> Column:
    return F.to_date(serial_to_timestamp(serial))


def epoch_normalize(value: Column) -> Column:
    """Epoch seconds or milliseconds, a number or text; NULL for 0 and for what is no number."""
    number = to_double(value.cast("string"))
    seconds = F.when(number > MILLIS_ABOVE, number / 1000).otherwise(number)
    return F.when(number != 0, after("1970-01-01", F.round(seconds, 6)))


def datetime_iso_normalize(value: Column) -> Column:
    """Milliseconds or ISO text as ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``."""
    text = value.cast("string")
    moment = F.when(text.rlike(WHOLE), F.timestamp_millis(to_long(text))).otherwise(F.try_to_timestamp(text))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def normalize_record_times(df: DataFrame, columns: Sequence[str], described_in: str = "attributes") -> DataFrame:
    """Records with their times in ISO form and without the source's description of them."""
    kept = df.drop(described_in)
    return kept.withColumns({c: datetime_iso_normalize(F.col(quoted(c))) for c in columns})


def iso_week_start(text: Column) -> Column:
    """Monday of an ISO week written yyyyww: week 1 is the one with January 4th."""
    year, week = (to_long(part).cast("int") for part in (F.substr(text, F.lit(1), F.lit(4)), F.substr(text, F.lit(5), F.lit(2))))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    valid = F.length(text).between(5, 6) & week.between(1, 53) & year.between(1, 9999)
    return F.when(valid, F.date_add(monday, (week - 1) * 7)).cast("timestamp_ntz")


def report_dimension_parse(dimension: str, value: Column) -> Column:
    """The time a report dimension stands for; other dimensions stay text."""
    if dimension == ISO_WEEK:
        return iso_week_start(value)
    if dimension in DIMENSION_FORMATS:
        return F.try_to_timestamp(value, F.lit(DIMENSION_FORMATS[dimension])).cast("timestamp_ntz")
    return value


def metric_type_cast(value: Column, kind: int) -> Column:
    """By declared kind: 0 text, 1 whole number, others floating point."""
    if kind == 0:
        return value
    return to_long(value) if kind == 1 else to_double(value)


def cast_metrics(df: DataFrame, kinds: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: metric_type_cast(F.col(quoted(c)), k) for c, k in kinds.items()})


def iso_timestamps(df: DataFrame, fields: Sequence[str] = ("created_at", "updated_at")) -> DataFrame:
    """Named fields from ISO text to times, those that exist."""
    present = [f for f in fields if f in df.columns]
    if not present:
        return df
    return df.withColumns({c: F.try_to_timestamp(quoted(c)).cast("timestamp_ntz") for c in present})
