"""Schema drift of event properties and personal data in documents, pages and conversations."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import drift, pii, profile, quality
from millrace.plans.registry import Tables, query
from millrace.session import materialize

NOW = datetime(2024, 2, 1)


def properties(t: Tables) -> DataFrame:
    """Event properties as a source sends them: from the 16th on, clicks send ``k`` as text,
    purchases have ``code`` instead of ``amount``, and views have ``amount``."""
    late = F.dayofmonth("ts") > 15
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    number, text = F.col("value").cast("decimal(18,2)").cast("double"), F.concat(F.lit("c"), k)
    line = F.to_json(
        F.struct(
            F.when(~(late & (kind == "click")), k.cast("bigint")).alias("k"),
            F.when(late & (kind == "click"), k).alias("k_"),
            F.when((kind == "purchase") & ~late | (kind == "view") & late, number + 0.125).alias("amount"),
            F.when((kind == "purchase") & late, text).alias("code"),
            F.when(kind == "error", F.lit(True)).alias("fatal"),
        )
    )
    return t.events.select(kind.alias("table_name"), late.alias("late"), F.replace(line, F.lit('"k_"'), F.lit('"k"')).alias("props"), "ts")


KEYS = """
keys AS (
  SELECT event_type AS table_name, day(ts) > 15 AS late, 'k' AS column_name,
         CASE WHEN day(ts) > 15 AND event_type = 'click' THEN 'string' ELSE 'bigint' END AS column_type FROM events
  UNION ALL SELECT event_type, day(ts) > 15, 'amount', 'double' FROM events
    WHERE (event_type = 'purchase' AND day(ts) <= 15) OR (event_type = 'view' AND day(ts) > 15)
  UNION ALL SELECT event_type, day(ts) > 15, 'code', 'string' FROM events WHERE event_type = 'purchase' AND day(ts) > 15
  UNION ALL SELECT event_type, day(ts) > 15, 'fatal', 'boolean' FROM events WHERE event_type = 'error'),
old AS (SELECT DISTINCT table_name, column_name, column_type FROM keys WHERE NOT late),
new AS (SELECT DISTINCT table_name, column_name, column_type FROM keys WHERE late)
"""

EVENTS = (
    KEYS
    + """,
drifted AS (
  SELECT 'app' AS source, coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name,
         CASE WHEN o.column_name IS NULL THEN 'column_added' WHEN n.column_name IS NULL THEN 'column_removed' ELSE 'type_changed' END AS event_type,
         CASE WHEN o.column_name IS NULL THEN 'additive' ELSE 'breaking' END AS severity,
         CASE WHEN o.column_name IS NULL THEN 'type=' || n.column_type WHEN n.column_name IS NULL THEN 'was=' || o.column_type
              ELSE o.column_type || ' -> ' || n.column_type END AS detail
  FROM old o FULL JOIN new n ON o.table_name = n.table_name AND o.column_name = n.column_name
  WHERE o.column_type IS DISTINCT FROM n.column_type)
"""
)


def keys(rows: DataFrame) -> DataFrame:
    return drift.observed_keys(rows, "props", F.lit("app"), F.col("table_name"))


def both_schemas(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = properties(t)
    return drift.keys_as_schema(keys(rows.where("NOT late"))), drift.keys_as_schema(keys(rows.where("late")))


@query(
    "observed_schema",
    f"WITH {KEYS} SELECT 'app' AS source, table_name, column_name, column_type, count(*) AS rows FROM keys GROUP BY ALL\n"
    + "\n".join(
        f"UNION ALL SELECT 'shop', 'orders', '{c}', '{kind}', count({c}) FROM orders"
        for c, kind in (
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
        )
    ),
)
def _observed_schema(t: Tables) -> DataFrame:
    # Keys of a JSON column, and the columns of a table with the number of rows that have each.
    columns = drift.observed_schema(t.spark, "shop", {"orders": t.orders})
    facts = profile.column_facts(t.orders, t.orders.schema.fields).select("column_name", (F.col("row_count") - F.col("null_count")).alias("rows"))
    return keys(properties(t)).unionByName(columns.join(facts, "column_name"))


@query("drift_events", f"WITH {EVENTS} SELECT * FROM drifted")
def _drift_events(t: Tables) -> DataFrame:
    return drift.drift_events(*both_schemas(t))


def nested(t: Tables) -> DataFrame:
    """Properties three levels deep whose types widen, break and appear in the second half of a month."""
    kind, late = F.col("event_type"), F.dayofmonth("ts") > 15
    user = F.col("user_id")
    level = (
        F.when(late & (kind == "click"), F.concat(user % 10, F.lit(".5")))
        .when(late & (kind == "view"), (user + 3_000_000_000).cast("string"))
        .otherwise((user % 10).cast("string"))
    )
    amount = F.when(late & (kind == "purchase"), F.lit('"two"')).otherwise((user % 5).cast("string"))
    note = F.when(late & (kind == "error"), F.lit('"text"')).when(kind == "view", F.lit("true")).otherwise(F.lit("null"))
    more = F.when(late & (kind == "error"), F.lit(', "trace": {"at": [[1, 2.5], [null]]}')).otherwise(F.lit(""))
    text = F.concat(
        F.lit('{"user": {"plan": {"level": '), level, F.lit("}"), more, F.lit('}, "items": [{"sku": "a", "qty": '), amount,
        F.lit('}, {"sku": "b"}], "note": '), note, F.lit("}"),
    )
    return t.events.select(kind.alias("table_name"), late.alias("late"), text.alias("props"))


PATHS = """
halves AS (SELECT event_type AS table_name, day(ts) > 15 AS late, count(*) AS rows FROM events GROUP BY ALL),
paths AS (
  SELECT table_name, late, unnest(['user', 'user.plan', 'items', 'items[]', 'items[].sku']) AS column_name,
         unnest(['object', 'object', 'array', 'object', 'string']) AS column_type, rows FROM halves
  UNION ALL SELECT table_name, late, 'user.plan.level', CASE WHEN late AND table_name = 'click' THEN 'double' WHEN late AND table_name = 'view' THEN 'bigint' ELSE 'int' END, rows FROM halves
  UNION ALL SELECT table_name, late, 'items[].qty', CASE WHEN late AND table_name = 'purchase' THEN 'string' ELSE 'int' END, rows FROM halves
  UNION ALL SELECT table_name, late, 'note', CASE WHEN late AND table_name = 'error' THEN 'string' WHEN table_name = 'view' THEN 'boolean' ELSE 'null' END, rows FROM halves
  UNION ALL SELECT table_name, late, unnest(['user.trace', 'user.trace.at', 'user.trace.at[]', 'user.trace.at[][]', 'user.trace.at[][]', 'user.trace.at[][]']),
         unnest(['object', 'array', 'array', 'int', 'double', 'null']), rows FROM halves WHERE late AND table_name = 'error'),
-- one type a path; the kinds above meet in one path only below the list of lists
typed AS (SELECT table_name, late, column_name, CASE WHEN count(*) > 1 THEN 'double' ELSE any_value(column_type) END AS column_type FROM paths GROUP BY ALL)
"""


def paths(rows: DataFrame) -> DataFrame:
    return drift.observed_paths(rows, "props", F.lit("app"), F.col("table_name"))


@query("observed_paths", f"WITH {PATHS} SELECT 'app' AS source, table_name, column_name, column_type AS kind, sum(rows)::BIGINT AS rows FROM paths GROUP BY ALL")
def _observed_paths(t: Tables) -> DataFrame:
    return paths(nested(t))


@query(
    "nested_drift",
    f"""
WITH {PATHS}, old AS (SELECT * FROM typed WHERE NOT late), new AS (SELECT * FROM typed WHERE late)
SELECT 'app' AS source, coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name,
       CASE WHEN o.column_name IS NULL THEN 'column_added' WHEN n.column_name IS NULL THEN 'column_removed' ELSE 'type_changed' END AS event_type,
       CASE WHEN o.column_name IS NULL THEN 'additive' ELSE 'breaking' END AS severity,
       CASE WHEN o.column_name IS NULL THEN 'type=' || n.column_type WHEN n.column_name IS NULL THEN 'was=' || o.column_type
            ELSE o.column_type || ' -> ' || n.column_type END AS detail
FROM old o FULL JOIN new n ON o.table_name = n.table_name AND o.column_name = n.column_name
WHERE o.column_type IS DISTINCT FROM n.column_type
""",
)
def _nested_drift(t: Tables) -> DataFrame:
    rows = nested(t)
    old, new = (drift.paths_as_schema(paths(rows.where(part))) for part in ("NOT late", "late"))
    return drift.drift_events(old, new)


@query(
    "drift_apply",
    f"""
WITH {EVENTS},
blocked AS (SELECT DISTINCT table_name FROM drifted WHERE severity = 'breaking')
SELECT 'baseline' AS kind, table_name, column_name, column_type AS detail FROM new WHERE table_name NOT IN (FROM blocked)
UNION ALL SELECT 'baseline', table_name, column_name, column_type FROM old WHERE table_name IN (FROM blocked)
UNION ALL SELECT 'attention', 'app', '', count(*) || ' breaking schema change(s) detected' FROM drifted WHERE severity = 'breaking'
UNION ALL SELECT 'accepted', table_name, column_name, column_type FROM new
""",
)
def _drift_apply(t: Tables) -> DataFrame:
    old, new = both_schemas(t)
    _, baseline, attention = drift.drift_apply(old, new, NOW)
    accepted, cleared = drift.drift_accept(baseline, new, attention, "app")

    def rows(kind: str, schema: DataFrame) -> DataFrame:
        return schema.select(F.lit(kind).alias("kind"), "table_name", "column_name", F.col("column_type").alias("detail"))

    flags = attention.unionByName(cleared).select(F.lit("attention").alias("kind"), F.col("source").alias("table_name"), F.lit("").alias("column_name"), F.col("reason").alias("detail"))
    return rows("baseline", baseline).unionByName(flags).unionByName(rows("accepted", accepted))


@query(
    "governance_query",
    """
SELECT event_id, ts, user_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') AS total
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id, user_id LIMIT 50 OFFSET 100
""",
)
def _governance_query(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "user_id", "event_type")
    return drift.governance_query(rows, "ts", {"event_type": "error", "user_id": None}, limit=50, offset=100)


@query(
    "keyset_pages",
    """
WITH o AS (SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type, row_number() OVER (ORDER BY date_trunc('day', ts) DESC, event_id, event_type) - 1 AS nth, count(*) OVER () AS n FROM events)
SELECT event_id, day, event_type, CAST(nth // (n // 4 + 1) AS INTEGER) AS page FROM o
""",
)
def _keyset_pages(t: Tables) -> DataFrame:
    # All pages of a walk over events whose times are days, so most rows tie.
    rows = t.events.select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type")
    size = rows.count() // 4 + 1
    pages, after = [], None
    while True:
        page = materialize(drift.keyset_page(rows, "day", size, after), "page").withColumn("page", F.lit(len(pages)))
        pages.append(page)
        last = page.orderBy(F.asc_nulls_first("day"), F.desc("event_id"), F.desc("event_type")).limit(1).collect()
        if not last or page.count() < size:
            return reduce(DataFrame.unionByName, pages)
        after = last[0]


@query("drift_summary", f"WITH {EVENTS} SELECT event_type, severity, count(*) AS events FROM drifted GROUP BY ALL")
def _drift_summary(t: Tables) -> DataFrame:
    return drift.drift_summary(drift.drift_events(*both_schemas(t)))


# --- personal data ----------------------------------------------------------------------


def re2(pattern: str) -> str:
    """The SQL engine has no look-around; its word boundary is the same place."""
    edges = {pii.START: r"\b", pii.END: r"\b", pii.OUTSIDE: "(?:^|[^0-9A-Za-z_:])", pii.BEYOND: "(?:$|[^0-9A-Za-z_:])"}
    for ours, theirs in edges.items():
        pattern = pattern.replace(ours, theirs)
    return pattern.replace("'", "''")


DIGITS = "regexp_replace(c, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i:
  CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) > 4
       THEN CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) * 2 END
       ELSE CAST(substr(reverse({DIGITS}), i, 1) AS INTEGER) END)) % 10 = 0"""


def count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(v, '{re2(pattern)}'))"


# Letters count as two digits; the remainder is carried from character to character.
MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''),
  lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) + 945 END)),
  lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b - 1000) % 97 END) = 1"""

HITS = {
    "EMAIL_ADDRESS": (count_sql(pii.EMAIL), "1.0"),
    "PHONE_NUMBER": (
        count_sql(pii.PHONE_ANY),
        f"CASE WHEN regexp_matches(v, '{re2(pii.PHONE_INTL)}') THEN 0.7 WHEN regexp_matches(v, '{re2(pii.PHONE_E164)}') THEN 0.6 ELSE 0.5 END",
    ),
    "CREDIT_CARD": (f"len(list_filter(regexp_extract_all(v, '{re2(pii.CARD)}'), lambda c: {LUHN}))", "1.0"),
    "US_SSN": (count_sql(pii.SSN), "0.5"),
    "IP_ADDRESS": (f"{count_sql(pii.IP)} + len(list_filter(regexp_extract_all(v, '{re2(pii.IP_SHORT)}'), lambda c: regexp_matches(c, '[0-9]')))", "0.6"),
    "IBAN_CODE": (f"len(list_filter(list_transform(regexp_extract_all(v, '{re2(pii.IBAN)}'), lambda c: replace(c, ' ', '')), lambda c: {MOD97}))", "1.0"),
}

PERSON = r"(?:[A-Z][a-z]+ ){1}[A-Z][a-z]+"


def hits_sql(person: bool = False) -> str:
    """Hits of each entity in vals(column_name, v)."""
    items = dict(HITS)
    if person:
        items["PERSON"] = (count_sql(PERSON), "0.85")
    return " UNION ALL ".join(
        f"SELECT column_name, '{e}' AS entity_type, {hits} AS hits, {score}::DOUBLE AS score FROM vals" for e, (hits, score) in items.items()
    )


def values_sql(table: str, columns: list[str], sample: int | None) -> str:
    union = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM {table}" for c in columns)
    every = f"SELECT DISTINCT column_name, v FROM ({union}) WHERE v IS NOT NULL AND v <> ''"
    if sample is None:
        return f"vals AS ({every})"
    return f"vals AS (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY md5(v)) <= {sample})"


def scan_sql(table: str, source: str, columns: list[str], sample: int | None, person: bool = False) -> str:
    return f"""
WITH {values_sql(table, columns, sample)}, h AS ({hits_sql(person)})
SELECT '{source}' AS source, '{table}' AS table_name, column_name, entity_type, max(score) AS confidence, CAST(sum(hits) AS BIGINT) AS sample_count
FROM h WHERE hits > 0 GROUP BY ALL"""


def scan(df: DataFrame, source: str, table: str, **options) -> DataFrame:
    return pii.pii_scan(df, source, table, NOW, **options)


TABLES = {"documents": ["text", "lang", "source"], "pages": ["url", "html"], "conversations": ["role", "text"]}


@query("pii_scan", " UNION ALL ".join(f"({scan_sql(n, 'web', c, 100)})" for n, c in TABLES.items()))
def _pii_scan(t: Tables) -> DataFrame:
    out = None
    for name in TABLES:
        part = scan(getattr(t, name), "web", name).drop("scanned_at")
        out = part if out is None else out.unionByName(part)
    return out


@query("pii_full_scan", " UNION ALL ".join(f"({scan_sql(n, 'web', c, None)})" for n, c in TABLES.items()))
def _pii_full_scan(t: Tables) -> DataFrame:
    out = None
    for name in TABLES:
        part = pii.pii_full_scan(getattr(t, name), "web", name, NOW).drop("scanned_at")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "pii_phone_intl",
    f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{re2(pii.PHONE_INTL)}') THEN 0.7 ELSE 0.6 END::DOUBLE AS score
FROM documents WHERE regexp_matches(text, '{re2(pii.PHONE_INTL)}') OR regexp_matches(text, '{re2(pii.PHONE_E164)}')
""",
)
def _pii_phone_intl(t: Tables) -> DataFrame:
    scored = t.documents.select("doc_id", pii.phone_score(F.col("text")).alias("score"))
    return scored.where(F.col("score").isNotNull())


def person(text):
    """Two capitalised words, in place of a model of names."""
    return F.regexp_count(text, F.lit(PERSON))


@query(
    "pii_min_ratio",
    f"""
WITH vals AS (SELECT lang AS column_name, text AS v FROM documents), h AS ({hits_sql(True)}),
f AS (SELECT column_name, entity_type, max(score) AS confidence, CAST(sum(hits) AS BIGINT) AS sample_count FROM h WHERE hits > 0 GROUP BY ALL)
SELECT f.* FROM f JOIN (SELECT column_name, count(*) AS n FROM vals GROUP BY 1) USING (column_name)
WHERE entity_type <> 'IP_ADDRESS' OR sample_count / n >= 0.02
""",
)
def _pii_min_ratio(t: Tables) -> DataFrame:
    # Languages stand for columns; addresses must occur in 2 % of the texts.
    values = t.documents.select(F.col("lang").alias("column_name"), F.col("text").alias("value"))
    found = pii.detect(values, person).groupBy("column_name", "entity_type").agg(F.max("score").alias("confidence"), F.sum("hits").alias("sample_count"))
    return pii.pii_min_ratio(found, pii.column_totals(values), {"IP_ADDRESS": 0.02})


@query(
    "pii_structured_suppress",
    f"""
WITH vals AS (SELECT source || CASE WHEN n_chars > 2000 THEN '_long' ELSE '_short' END AS column_name, text AS v FROM documents),
h AS ({hits_sql(True)}),
f AS (SELECT column_name, entity_type, CAST(sum(hits) AS BIGINT) AS sample_count FROM h WHERE hits > 0 GROUP BY ALL),
s AS (SELECT column_name FROM vals GROUP BY 1 HAVING avg(length(v)) > 100 AND bool_or(contains(v, '[') OR contains(v, ']') OR contains(v, '{{') OR contains(v, chr(10))))
SELECT * FROM f WHERE NOT (entity_type = 'PERSON' AND column_name IN (FROM s))
""",
)
def _pii_structured_suppress(t: Tables) -> DataFrame:
    group = F.concat("source", F.when(F.col("n_chars") > 2000, "_long").otherwise("_short"))
    values = t.documents.select(group.alias("column_name"), F.col("text").alias("value"))
    found = pii.detect(values, person).groupBy("column_name", "entity_type").agg(F.sum("hits").alias("sample_count"))
    return pii.pii_structured_suppress(found, pii.column_totals(values))


@query(
    "pii_overrides",
    f"""
WITH f AS ({scan_sql("documents", "web", TABLES["documents"], None)} UNION ALL ({scan_sql("pages", "web", TABLES["pages"], None)}))
SELECT source, table_name, column_name, entity_type, confidence, sample_count FROM f WHERE table_name <> 'pages' OR column_name <> 'html'
UNION ALL SELECT 'web', 'documents', 'lang', 'MANUAL_OVERRIDE', 1.0, 0
""",
)
def _pii_overrides(t: Tables) -> DataFrame:
    found = pii.pii_full_scan(t.documents, "web", "documents", NOW).unionByName(pii.pii_full_scan(t.pages, "web", "pages", NOW))
    reviewed = t.spark.createDataFrame(
        [("web", "pages", "html", "not_pii"), ("web", "documents", "lang", "pii"), ("web", "documents", "text", "pii")],
        "source string, table_name string, column_name string, pii_status string",
    )
    return pii.pii_overrides(found, reviewed, NOW).drop("scanned_at")


@query(
    "pii_new_findings",
    f"""
WITH f AS ({scan_sql("documents", "web", TABLES["documents"], None)}), k AS ({scan_sql("documents", "web", TABLES["documents"], 20)})
SELECT * FROM f WHERE (column_name, entity_type) NOT IN (SELECT (column_name, entity_type) FROM k)
""",
)
def _pii_new_findings(t: Tables) -> DataFrame:
    # What the full scan finds and an earlier scan of a small sample did not.
    known = scan(t.documents, "web", "documents", sample_size=20)
    return pii.pii_new_findings(pii.pii_full_scan(t.documents, "web", "documents", NOW), known).drop("scanned_at")


@query(
    "pii_store_findings",
    f"""
WITH f AS ({scan_sql("documents", "web", TABLES["documents"], None)}), k AS ({scan_sql("pages", "web", TABLES["pages"], 50)})
SELECT * FROM f UNION ALL SELECT * FROM k
""",
)
def _pii_store_findings(t: Tables) -> DataFrame:
    # A full scan of one table replaces what a scan of samples stored for it; the other table's findings stay.
    stored = scan(t.documents, "web", "documents", sample_size=50).unionByName(scan(t.pages, "web", "pages", sample_size=50))
    return pii.store_findings(stored, pii.pii_full_scan(t.documents, "web", "documents", NOW)).drop("scanned_at")


@query(
    "quality_counts_by_source",
    "SELECT source, count(*) AS tables, sum(n_chars)::BIGINT AS total_rows FROM documents GROUP BY 1",
)
def _quality_counts_by_source(t: Tables) -> DataFrame:
    # Each document as a table of its source, its length as the row count.
    owners = t.documents.select(F.col("doc_id").cast("string").alias("table_name"), "source")
    counts = t.documents.select(F.col("doc_id").cast("string").alias("table_name"), F.col("n_chars").alias("row_count"))
    return quality.source_summary(counts, owners).withColumnRenamed("table_count", "tables")
