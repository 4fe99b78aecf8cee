"""Personal data in text columns, found by patterns and check digits.

The recognisers are our own: plain expressions that stay in the JVM. Names of persons need a
model of language, which is not part of this; a column expression (for example a pandas UDF)
that counts names can be passed in and is then subject to the same rules.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import INTERNAL_PREFIXES, user_columns
from millrace.operators.load import write_delete_insert
from millrace.operators.monitor import moment
from millrace.operators.profile import melt, value_sample

# Sample size, least score, least share of values per entity, and the length and
# characters that mark a column as structured text.
SAMPLE_SIZE = 100
MIN_SCORE = 0.5
MIN_RATIO = {"PERSON": 0.30}
STRUCTURED_LENGTH = 100
STRUCTURED_CHARACTERS = r"[\[\]{\n]"

# A place between two characters of which one is not a letter, digit or underscore.
START, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

# International phone numbers, with separators and in E.164 form, and their scores.
PHONE_INTL = r"\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?[\s\-.]?\d{1,4}[\s\-.]?\d{1,9}"
PHONE_E164 = r"\+\d{7,15}"
PHONE_INTL_SCORE, PHONE_E164_SCORE = 0.7, 0.6

# The parts of an address have these lengths at most, which also keeps a long run of letters without
# an @ from being searched anew from each of its characters.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,63}"
PHONE_LOCAL = rf"\(?{START}[2-9]\d{{2}}\)?[-. ]\d{{3}}[-. ]\d{{4}}{END}"
PHONE_PLAIN = rf"{START}[2-9]\d{{9}}{END}"
PHONE_ANY = f"{PHONE_INTL}|{PHONE_E164}|{PHONE_LOCAL}|{PHONE_PLAIN}"
CARD = rf"{START}(?:\d[ -]?){{12,18}}\d{END}"
SSN = rf"{START}\d{{3}}-\d{{2}}-\d{{4}}{END}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"{START}(?:(?:{OCTET}\.){{3}}{OCTET}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}){END}"
# An address with a run of zero groups left out, be it at its beginning or end; it has a digit.
GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"
OUTSIDE, BEYOND = "(?<![0-9A-Za-z_:])", "(?![0-9A-Za-z_:])"
IP_SHORT = rf"{START}{GROUPS}::(?:{GROUPS}{END}|{BEYOND})|{OUTSIDE}::{GROUPS}{END}"
# Account numbers as one word or in groups of four.
IBAN = rf"{START}[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){END}"


def _count(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_count(text, F.lit(pattern))


def iban_valid(code: Column) -> Column:
    """The check of an account number: moved, letters as numbers, the rest by 97 is 1."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        digit = char.rlike("[0-9]")
        number = F.ascii(char) - F.when(digit, 48).otherwise(55)
        return ((rest * F.when(digit, 10).otherwise(100) + number) % 97).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def count_cards(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    return F.size(F.filter(found, lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", "")))).cast("int")


def count_ibans(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(IBAN), F.lit(0))
    return F.size(F.filter(found, lambda c: iban_valid(F.replace(c, F.lit(" "))))).cast("int")


def count_addresses(text: Column) -> Column:
    short = F.regexp_extract_all(text, F.lit(IP_SHORT), F.lit(0))
    return F.regexp_count(text, F.lit(IP)) + F.size(F.filter(short, lambda c: c.rlike("[0-9]")))


def phone_score(text: Column) -> Column:
    """The best score of the international patterns, NULL without a match."""
    return F.when(text.rlike(PHONE_INTL), PHONE_INTL_SCORE).when(text.rlike(PHONE_E164), PHONE_E164_SCORE)


# What a text must have for a recogniser to look at it: most text is passed over by one cheap search.
AT, DIGIT = "_with_at", "_with_digit"

# entity -> (what the text must have, hits of a text, score of a text with hits)
RECOGNISERS: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "EMAIL_ADDRESS": (AT, _count(EMAIL), lambda text: F.lit(1.0)),
    "PHONE_NUMBER": (DIGIT, _count(PHONE_ANY), lambda text: F.coalesce(phone_score(text), F.lit(0.5))),
    "CREDIT_CARD": (DIGIT, count_cards, lambda text: F.lit(1.0)),
    "US_SSN": (DIGIT, _count(SSN), lambda text: F.lit(0.5)),
    "IP_ADDRESS": (DIGIT, count_addresses, lambda text: F.lit(0.6)),
    "IBAN_CODE": (DIGIT, count_ibans, lambda text: F.lit(1.0)),
}
PERSON_SCORE = 0.85


def detect(values: DataFrame, person: Callable[[Column], Column] | None = None) -> DataFrame:
    """Hits per value and entity: every recogniser in one pass over ``value``."""
    text = F.col("value")
    counts = {entity: hits(F.col(needs)) for entity, (needs, hits, _) in RECOGNISERS.items()}
    score = F.lit(PERSON_SCORE)
    for entity, (_, _, scored) in RECOGNISERS.items():
        score = F.when(F.col("entity_type") == entity, scored(text)).otherwise(score)
    if person is not None:
        counts["PERSON"] = person(text)
    found = F.array(*[F.struct(F.lit(e).alias("entity_type"), c.cast("bigint").alias("hits")) for e, c in counts.items()])
    # A NULL text gives a NULL count, so a text without digits costs the search for one.
    marked = values.withColumns({AT: F.when(F.contains(text, F.lit("@")), text), DIGIT: F.when(text.rlike("[0-9:]"), text)})
    hit = marked.select(*[F.col(c) for c in values.columns], F.inline(F.filter(found, lambda f: f["hits"] > 0)))
    return hit.withColumn("score", score.cast("double")).where(F.col("score") >= MIN_SCORE)


def text_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in user_columns(df, INTERNAL_PREFIXES) if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def column_totals(values: DataFrame) -> DataFrame:
    """Per column: how many values, their mean length, and whether they look structured."""
    return values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_values"),
        F.avg(F.length("value")).alias("avg_length"),
        F.max(F.col("value").rlike(STRUCTURED_CHARACTERS)).alias("has_delimiter"),
    )


def pii_structured_suppress(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """Without names of persons in columns of long structured text."""
    structured = totals.where((F.col("avg_length") > STRUCTURED_LENGTH) & F.col("has_delimiter"))
    barred = structured.select("column_name", F.lit("PERSON").alias("entity_type"))
    return findings.join(barred, ["column_name", "entity_type"], "left_anti")


def pii_min_ratio(findings: DataFrame, totals: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """Without entities that too few of a column's values have."""
    least = F.lit(None).cast("double")
    for entity, ratio in (MIN_RATIO if ratios is None else ratios).items():
        least = F.when(F.col("entity_type") == entity, F.lit(ratio)).otherwise(least)
    joined = findings.join(totals.select("column_name", "total_values"), "column_name")
    kept = least.isNull() | (F.col("sample_count") / F.col("total_values") >= least)
    return joined.where(kept).select(*findings.columns)


def _findings(hits: DataFrame, totals: DataFrame | None, source: str, table: str, now: datetime | Column) -> DataFrame:
    found = hits.groupBy("column_name", "entity_type").agg(F.max("score").alias("confidence"), F.sum("hits").alias("sample_count"))
    if totals is not None:
        found = pii_min_ratio(pii_structured_suppress(found, totals), totals)
    return found.select(
        F.lit(source).alias("source"), F.lit(table).alias("table_name"), "column_name", "entity_type", "confidence", "sample_count", moment(now).alias("scanned_at")
    )


def pii_scan(
    df: DataFrame,
    source: str,
    table: str,
    now: datetime | Column,
    sample_size: int = SAMPLE_SIZE,
    person: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Entities in a sample of distinct values of every text column."""
    sample = value_sample(df, text_columns(df), sample_size)
    totals = column_totals(sample) if person is not None else None
    return _findings(detect(sample, person), totals, source, table, now)


def pii_full_scan(
    df: DataFrame, source: str, table: str, now: datetime | Column, person: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The same over every distinct value.

    Texts are matched where they are read; only those with a hit are told apart, by their
    digest, so the shuffle carries no text.
    """
    values = melt(df, text_columns(df)).where(F.col("value") != "")
    hits = (
        detect(values, person)
        .groupBy("column_name", "entity_type", F.sha2("value", 256).alias("digest"))
        .agg(F.max("hits").alias("hits"), F.max("score").alias("score"))
    )
    totals = None
    if person is not None:
        facts = values.groupBy("column_name", F.sha2("value", 256).alias("digest")).agg(
            F.max(F.length("value")).alias("length"), F.max(F.col("value").rlike(STRUCTURED_CHARACTERS)).alias("delimiter")
        )
        totals = facts.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("total_values"), F.avg("length").alias("avg_length"), F.max("delimiter").alias("has_delimiter")
        )
    return _findings(hits, totals, source, table, now)


def pii_overrides(findings: DataFrame, overrides: DataFrame, now: datetime | Column) -> DataFrame:
    """Findings after review: ``not_pii`` clears a column, ``pii`` marks one that was not detected."""
    keys = ["source", "table_name", "column_name"]
    cleared = overrides.where("pii_status = 'not_pii'").select(*keys).distinct()
    kept = findings.join(cleared, keys, "left_anti").select(*findings.columns)
    marked = overrides.where("pii_status = 'pii'").select(*keys).distinct().join(kept.select(*keys).distinct(), keys, "left_anti")
    manual = marked.select(
        *keys, F.lit("MANUAL_OVERRIDE").alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit(0).cast("bigint").alias("sample_count"), moment(now).alias("scanned_at")
    )
    return kept.unionByName(manual)


def pii_new_findings(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of a column and entity not seen before."""
    keys = ["source", "table_name", "column_name", "entity_type"]
    return findings.join(known.select(*keys).distinct(), keys, "left_anti").select(*findings.columns)


def store_findings(stored: DataFrame, findings: DataFrame) -> DataFrame:
    """Stored findings after a scan: those of the scanned tables are replaced."""
    return write_delete_insert(stored, findings, ["source", "table_name"])
