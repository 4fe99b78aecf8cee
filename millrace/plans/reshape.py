"""Reshaping: the given tables are put in the shapes sources send, and taken apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import records, times
from millrace.functions.records import FieldLabels
from millrace.plans.registry import Tables, query


@query(
    "serial_to_timestamp",
    """
WITH s AS (SELECT o_orderkey, date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) + (o_custkey % 24) / 24.0::DOUBLE AS serial FROM orders)
SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_seconds(CAST(round(serial * 86400) AS BIGINT)) AS moment,
       CAST(CAST(TIMESTAMP '1899-12-30' + to_seconds(CAST(round(serial * 86400) AS BIGINT)) AS DATE) AS VARCHAR) AS day FROM s
""",
)
def _serial_to_timestamp(t: Tables) -> DataFrame:
    serial = F.date_diff("o_orderdate", F.lit("1899-12-30").cast("date")) + (F.col("o_custkey") % 24) / F.lit(24.0)
    return t.orders.select("o_orderkey", times.serial_to_timestamp(serial).alias("moment"), times.serial_to_date(serial).cast("string").alias("day"))


@query(
    "sheet_rows_clean",
    """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderstatus = 'P' THEN 'x' END AS note FROM orders WHERE o_orderpriority <> '5-LOW'
""",
)
def _sheet_rows_clean(t: Tables) -> DataFrame:
    # Rows as a sheet gives them: no cells, two cells with an empty one, or all cells.
    customer, unnamed = F.col("o_custkey").cast("string"), F.lit("dropped")
    values = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>"))
        .when(F.col("o_orderstatus") == "F", F.array(customer, unnamed, F.lit("")))
        .when(F.col("o_orderstatus") == "O", F.array(customer, unnamed, F.col("o_orderpriority")))
        .otherwise(F.array(customer, unnamed, F.col("o_orderpriority"), F.lit("x")))
    )
    sheet = t.orders.select("o_orderkey", values.alias("cells"))
    return records.sheet_rows_clean(sheet, "cells", ["customer", None, "priority", "note"], ["o_orderkey"])


@query(
    "range_status",
    """
WITH r AS (SELECT c_custkey % 1200 AS range_name FROM customer GROUP BY 1),
f AS (SELECT o_custkey AS range_name, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT CAST(range_name AS VARCHAR) AS range_name, coalesce(n, 0) AS row_count, coalesce(n, 0) <= 1 OR s = 'P' AS skipped,
       CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n = 1 THEN 'header_only' WHEN s = 'P' THEN 'blank_first_row' END AS reason FROM r LEFT JOIN f USING (range_name)
""",
)
def _range_status(t: Tables) -> DataFrame:
    ranges = t.customer.select((F.col("c_custkey") % 1200).cast("string").alias("range_name")).distinct()
    blank = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    rows = t.orders.where(F.col("o_orderdate") >= "2001-01-01").select(
        F.col("o_custkey").cast("string").alias("range_name"), F.col("o_orderkey").alias("row_no"), blank.alias("values")
    )
    return records.range_status(ranges, rows)


@query(
    "report_dimension_parse",
    """
SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS date, date_trunc('hour', ts)::TIMESTAMP AS dateHour, date_trunc('minute', ts)::TIMESTAMP AS dateHourMinute,
       date_trunc('month', ts)::TIMESTAMP AS yearMonth, date_trunc('year', ts)::TIMESTAMP AS year, date_trunc('week', ts)::TIMESTAMP AS isoYearIsoWeek, event_type AS eventName
FROM events
UNION ALL
SELECT -o_orderkey, o_orderdate, o_orderdate, o_orderdate, date_trunc('month', o_orderdate)::TIMESTAMP, date_trunc('year', o_orderdate)::TIMESTAMP,
       date_trunc('week', o_orderdate)::TIMESTAMP, o_orderstatus FROM orders
""",
)
def _report_dimension_parse(t: Tables) -> DataFrame:
    stamped = t.events.select("event_id", "ts", "event_type").unionByName(
        t.orders.select((-F.col("o_orderkey")).alias("event_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("event_type"))
    )
    # An ISO week has the year of its Thursday.
    thursday = F.date_add(F.to_date("ts"), F.lit(3) - F.weekday("ts"))
    week = F.concat(F.year(thursday).cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    text = {name: F.date_format("ts", fmt) for name, fmt in times.DIMENSION_FORMATS.items()} | {times.ISO_WEEK: week, "eventName": F.col("event_type")}
    return stamped.select("event_id", *[times.report_dimension_parse(n, v).alias(n) for n, v in text.items()])


@query(
    "metric_type_cast",
    "SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_partkey AS part, l_extendedprice AS price, NULL::BIGINT AS broken FROM lineitem",
)
def _metric_type_cast(t: Tables) -> DataFrame:
    text = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_partkey").cast("string").alias("part"),
        F.col("l_extendedprice").cast("string").alias("price"), F.col("l_returnflag").alias("broken"),
    )
    return times.cast_metrics(text, {"flag": 0, "part": 1, "price": 4, "broken": 1})


@query(
    "flatten_struct",
    """
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, l_returnflag AS device, round(l_extendedprice * 100) / 1000000 AS cost, l_partkey AS clicks, l_discount AS ctr,
       l_linestatus AS other, l_orderkey AS campaign_id, l_linenumber AS campaign_budget_amount, l_suppkey AS customer FROM lineitem
""",
)
def _flatten_struct(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_returnflag").alias("device")).alias("segments"),
        F.struct(
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string").alias("cost_micros"),
            F.col("l_partkey").cast("string").alias("clicks"),
            F.col("l_discount").cast("string").alias("ctr"),
            F.col("l_linestatus").alias("other"),
        ).alias("metrics"),
        F.struct(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("amount")).alias("budget")).alias("campaign"),
        F.col("l_suppkey").alias("customer"),
    )
    return records.flatten_struct(rows).withColumn("date", F.col("date").cast("string"))


STATUS = FieldLabels("h1", "status", "enum", {"F": "fulfilled", "O": "open"})
FLAGS = FieldLabels("h2", "flags", "set", {"A": "accepted", "R": "returned"})


@query(
    "enum_relabel",
    """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
       (SELECT string_agg(CASE f WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE f END, '|' ORDER BY f) FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem WHERE l_orderkey = o_orderkey)) AS flags,
       o_custkey AS owner FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""",
)
def _enum_relabel(t: Tables) -> DataFrame:
    # Three flags exist, so the list of an order is as short.
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("h2"))
    deals = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("h1"), F.col("o_custkey").alias("h3")).join(flags, "id")
    out = records.enum_relabel(deals, [STATUS, FLAGS, FieldLabels("h3", "owner", "int")])
    return out.withColumn("flags", F.array_join("flags", "|"))


@query(
    "field_mapping_merge",
    """
WITH k AS (SELECT 'brand' || p_size AS key, min('Name ' || p_size) AS name, p_brand AS option_id, 'old ' || min(p_name) AS label FROM part WHERE p_retailprice < 1500 GROUP BY p_size, p_brand),
f AS (SELECT 'brand' || p_size AS key, 'Renamed ' || p_size AS name, p_brand AS option_id, 'new ' || min(p_name) AS label FROM part GROUP BY p_size, p_brand)
SELECT * FROM k
UNION ALL
SELECT key, coalesce((SELECT min(name) FROM k WHERE k.key = f.key), name) AS name, option_id, label FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = f.key AND k.option_id = f.option_id)
""",
)
def _field_mapping_merge(t: Tables) -> DataFrame:
    key = F.concat(F.lit("brand"), F.col("p_size").cast("string")).alias("key")

    def labels(parts: DataFrame, title: str, word: str) -> DataFrame:
        rows = parts.groupBy(key, "p_size", F.col("p_brand").alias("option_id")).agg(F.min("p_name").alias("n"))
        name = F.concat(F.lit(f"{title} "), F.col("p_size").cast("string")).alias("name")
        return rows.select("key", name, "option_id", F.concat(F.lit(f"{word} "), "n").alias("label"))

    known = labels(t.part.where("p_retailprice < 1500"), "Name", "old")
    return records.field_mapping_merge(known, labels(t.part, "Renamed", "new"))


@query(
    "custom_field_pivot",
    """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'open' END AS "Status", o_orderpriority AS "Priority",
       CASE o_orderstatus WHEN 'F' THEN 'fulfilled|x' ELSE 'x' END AS "Tags", 1 AS left_over FROM orders
""",
)
def _custom_field_pivot(t: Tables) -> DataFrame:
    def entry(key: int, value):
        return F.struct(F.lit(key).cast("bigint").alias("id"), value.alias("value"))

    tags = F.when(F.col("o_orderstatus") == "F", F.lit('["F", "x"]')).otherwise(F.lit('["x"]'))
    tickets = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.array(entry(1, F.col("o_orderstatus")), entry(2, F.col("o_orderpriority")), entry(3, tags), entry(9, F.lit("?"))).alias("custom_fields"),
    )
    known = [FieldLabels("1", "Status", "enum", STATUS.options), FieldLabels("2", "Priority", "text"), FieldLabels("3", "Tags", "set", STATUS.options)]
    out = records.custom_field_pivot(tickets, known)
    return out.select("id", "Status", "Priority", F.array_join("Tags", "|").alias("Tags"), F.size("custom_fields").alias("left_over"))


@query(
    "hoist_properties",
    """
SELECT CAST(l_orderkey AS VARCHAR) AS hs_object_id, l_extendedprice AS amount, l_linenumber AS id, 'deal' AS kind,
       l_orderkey || '-' || l_suppkey || CASE WHEN l_partkey <> l_suppkey THEN '|' || l_orderkey || '-' || l_partkey ELSE '' END AS companies FROM lineitem
""",
)
def _hoist_properties(t: Tables) -> DataFrame:
    # A line's supplier twice and its part as associations: the repeated one counts once.
    ids = F.array(*[F.struct(F.col(c).alias("id")) for c in ("l_suppkey", "l_partkey", "l_suppkey")])
    rows = t.lineitem.select(
        F.col("l_linenumber").alias("id"),
        F.struct(F.col("l_orderkey").cast("string").alias("hs_object_id"), F.col("l_extendedprice").alias("amount")).alias("properties"),
        F.struct(F.struct(ids.alias("results")).alias("companies")).alias("associations"),
    )
    out = records.hoist_properties(rows, ["companies"], {"kind": "deal"})
    pairs = F.transform("companies", lambda c: F.concat_ws("-", c["value"], c["companies_id"].cast("string")))
    return out.withColumn("companies", F.array_join(pairs, "|"))


@query(
    "stage_unpivot",
    """
SELECT o_custkey AS id, min(o_orderdate) AS "hs_v2_date_entered_", CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END AS stage
FROM orders WHERE o_custkey % 100 > 0 GROUP BY 1, 3
""",
)
def _stage_unpivot(t: Tables) -> DataFrame:
    entered = [F.min(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate"))).alias(f"hs_v2_date_entered_{i}") for i, s in enumerate("FOP", 1)]
    deals = t.orders.groupBy(F.when(F.col("o_custkey") % 100 > 0, F.col("o_custkey")).alias("id")).agg(*entered)
    return records.stage_unpivot(deals)


@query(
    "property_history_explode",
    """
SELECT o_orderkey AS object_id, 'status' AS property_name, o_orderstatus AS value, CAST(o_orderdate AS VARCHAR) AS timestamp FROM orders
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, CAST(o_orderdate AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'priority', 'none', '' FROM orders
""",
)
def _property_history_explode(t: Tables) -> DataFrame:
    def entry(value, at):
        return F.struct(value.alias("value"), at.alias("timestamp"))

    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    history = F.create_map(
        F.lit("status"), F.array(entry(F.col("o_orderstatus"), at)),
        F.lit("priority"), F.array(entry(F.col("o_orderpriority"), at), entry(F.lit("none"), F.lit(""))),
    )
    objects = t.orders.select(F.col("o_orderkey").alias("id"), history.alias("propertiesWithHistory"))
    # Objects without history come first: they are skipped, not the end of the read.
    empty = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast(objects.schema["propertiesWithHistory"].dataType).alias("propertiesWithHistory"))
    return records.property_history_explode(empty.unionByName(objects))


@query("associations_explode", "SELECT CAST(l_orderkey AS VARCHAR) AS value, CAST(l_suppkey AS VARCHAR) AS companies_id FROM lineitem UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem")
def _associations_explode(t: Tables) -> DataFrame:
    ids = F.array(*[F.struct(F.col(c).cast("string").alias("id")) for c in ("l_suppkey", "l_partkey")])
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("hs_object_id"), ids.alias("results"))
    return records.associations_explode(rows, "companies")


@query(
    "epoch_normalize",
    "SELECT event_id, make_timestamp(CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) // 1000 * 1000 END) AS moment FROM events",
)
def _epoch_normalize(t: Tables) -> DataFrame:
    # Whole seconds, milliseconds, or seconds with a fraction, all as text.
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 3
    text = (
        F.when(kind == 0, F.floor(micros / 1000000).cast("string"))
        .when(kind == 1, F.floor(micros / 1000).cast("string"))
        .otherwise((F.floor(micros / 1000).cast("decimal(20,0)") / 1000).cast("decimal(20,3)").cast("string"))
    )
    return t.events.select("event_id", times.epoch_normalize(text).alias("moment"))


@query(
    "datetime_iso_normalize",
    "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM events",
)
def _datetime_iso_normalize(t: Tables) -> DataFrame:
    # Milliseconds for even events, ISO text with an offset for the others.
    stamp = F.col("ts").cast("timestamp")
    millis = F.unix_millis(stamp)
    east = F.date_format(F.timestamp_millis(millis) + F.make_dt_interval(hours=F.lit(2)), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = F.when(F.col("event_id") % 2 == 0, millis.cast("string")).otherwise(F.concat(east, F.lit("+02:00")))
    # Records of the source carry their own description, which is not data.
    described = t.events.select("event_id", text.alias("text"), F.struct(F.lit("Event").alias("type"), "event_type").alias("attributes"))
    return times.normalize_record_times(described, ["text"])


@query(
    "sentinel_keys",
    """
SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS campaign_id, CASE WHEN l_returnflag = 'A' THEN CAST(l_suppkey AS VARCHAR) ELSE 'no_adset_id' END AS adset_id,
       CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) ELSE 'no_ad_id' END AS ad_id, 'no_date_start' AS date_start FROM lineitem
""",
)
def _sentinel_keys(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey",
        F.col("l_partkey").alias("campaign_id"),
        F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")).alias("adset_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("ad_id"),
    )
    return records.sentinel_keys(rows)


@query(
    "report_explode_by_date",
    """
SELECT o_custkey AS site, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'all' AS label, o_orderkey AS visits FROM orders
UNION ALL SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR), 'a', 1 FROM orders
UNION ALL SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR), 'b', o_custkey FROM orders
""",
)
def _report_explode_by_date(t: Tables) -> DataFrame:
    # One report per order: its day holds a row, the next day a list of two.
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    after = F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")
    report = F.concat(
        F.lit('{"'), day, F.lit('": {"label": "all", "visits": '), F.col("o_orderkey").cast("string"), F.lit('}, "'), after,
        F.lit('": [{"label": "a", "visits": 1}, {"label": "b", "visits": '), F.col("o_custkey").cast("string"), F.lit("}]}"),
    )
    rows = t.orders.select(F.col("o_custkey").alias("site"), report.alias("report"))
    out = records.report_explode_by_date(rows, "report", "label: string, visits: bigint", ["site"])
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "attribute_pivot",
    "SELECT 'r1' AS report_id, o_orderkey AS item_id, o_orderstatus AS status, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS hired, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS team FROM orders",
)
def _attribute_pivot(t: Tables) -> DataFrame:
    def entry(name: str, kind: str, value):
        return F.struct(F.lit(name).alias("attribute_id"), F.lit(kind).alias("data_type"), value.alias("value"))

    always = [entry("status", "string", F.col("o_orderstatus")), entry("hired", "date", F.date_format("o_orderdate", "yyyy-MM-dd"))]
    team = entry("team", "string", F.col("o_orderpriority"))
    entries = F.when(F.col("o_orderstatus") == "F", F.array(*always, team)).otherwise(F.array(*always))
    rows = t.orders.select(F.lit("r1").alias("report_id"), F.col("o_orderkey").alias("item_id"), entries.alias("attributes"))
    out = records.attribute_pivot(rows, {"status": "string", "hired": "date", "team": "string"})
    return out.withColumn("hired", F.col("hired").cast("string"))


@query(
    "nested_totals",
    """
SELECT conv_id, turn, role AS reactions, length(text)::BIGINT AS "reactions_totalCount", turn || ':' || role || ':' || turn * 2 || '|' || turn + 1 || ':' || role || ':' || 0 AS comments,
       CASE WHEN role = 'user' THEN 0 ELSE turn * 10 END AS "comments_totalCount" FROM conversations
""",
)
def _nested_totals(t: Tables) -> DataFrame:
    # A message as an issue with two comments; a missing total counts as 0.
    def connection(nodes, total):
        return F.struct(nodes.alias("nodes"), total.cast("bigint").alias("totalCount"))

    def comment(key, total):
        return F.struct(key.alias("id"), connection(F.array("role"), total).alias("reactions"))

    turn = F.col("turn")
    issues = t.conversations.select(
        "conv_id",
        "turn",
        connection(F.array("role"), F.length("text")).alias("reactions"),
        connection(F.array(comment(turn, turn * 2), comment(turn + 1, F.lit(None))), F.when(F.col("role") != "user", turn * 10)).alias("comments"),
    )
    out = records.nested_totals(issues)
    inner = F.transform("comments", lambda c: F.concat_ws(":", c["id"].cast("string"), F.array_join(c["reactions"], ","), c["reactions_totalCount"].cast("string")))
    return out.select("conv_id", "turn", F.array_join("reactions", ",").alias("reactions"), "reactions_totalCount", F.array_join(inner, "|").alias("comments"), "comments_totalCount")


@query(
    "normalize_nested",
    """
WITH l1 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i1 FROM documents),
l2 AS (SELECT doc_id, i1, unnest(string_split(line, '. ')) AS sentence, generate_subscripts(string_split(line, '. '), 1) AS i2 FROM l1),
l3 AS (SELECT doc_id, i1, i2, unnest(string_split(sentence, ' ')) AS word, generate_subscripts(string_split(sentence, ' '), 1) AS i3 FROM l2),
l4 AS (SELECT doc_id, i1, i2, i3, unnest(string_split(word, 'e')) AS value, generate_subscripts(string_split(word, 'e'), 1) AS i4 FROM l3)
SELECT doc_id AS parent_parent_parent_parent_doc_id, CAST(i1 - 1 AS INTEGER) AS parent_parent_parent_list_idx,
       CAST(i2 - 1 AS INTEGER) AS parent_parent_list_idx, CAST(i3 - 1 AS INTEGER) AS parent_list_idx, CAST(i4 - 1 AS INTEGER) AS list_idx, value FROM l4
""",
)
def _normalize_nested(t: Tables) -> DataFrame:
    # Lines, sentences, words and the parts of words: lists in lists, four levels down.
    def nested(text, name, marks):
        parts = F.split(text, marks[0])
        return F.transform(parts, lambda x: F.struct(nested(x, "n" + name, marks[1:]).alias("n" + name))) if len(marks) > 1 else parts

    levels = nested(F.col("text"), "lines", ["\n", "\\. ", " ", "e"])
    tables = records.split_nested(t.documents.select("doc_id", levels.alias("lines")), "documents", ["doc_id"])
    return tables[max(tables, key=lambda name: name.count("__"))]


@query(
    "bson_normalize",
    """
SELECT o_orderkey, lpad(to_base(o_orderkey, 16), 24, '0') AS id, printf('%.2f', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at_, CAST(o_orderdate AS TIMESTAMP) AS at_time, CAST(o_orderdate AS TIMESTAMP) AS day_time,
       '^a.*' AS expression, o_orderstatus AS plain FROM orders
""",
)
def _bson_normalize(t: Tables) -> DataFrame:
    key = F.lpad(F.hex("o_orderkey"), 24, "0")
    price = F.format_string("%.2f", "o_totalprice")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    rows = t.orders.select(
        "o_orderkey",
        F.concat(F.lit('{"$oid": "'), key, F.lit('"}')).alias("id"),
        F.concat(F.lit('{"$numberDecimal": "'), price, F.lit('"}')).alias("price"),
        F.concat(F.lit('{"$timestamp": {"t": '), seconds, F.lit(', "i": 1}}')).alias("at_"),
        F.lit('{"$regularExpression": {"pattern": "^a.*", "options": "i"}}').alias("expression"),
        F.col("o_orderstatus").alias("plain"),
    )
    days = F.concat(F.lit('{"$date": "'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))
    times = {"at_time": records.bson_timestamp(F.col("at_")), "day_time": records.bson_timestamp(days)}
    text = {c: records.bson_normalize(F.col(c)) for c in ("id", "price", "at_", "expression", "plain")}
    rows = rows.join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey").withColumns(times).drop("o_orderdate")
    return rows.withColumns(text)


@query(
    "content_hash",
    "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text",
)
def _content_hash(t: Tables) -> DataFrame:
    return records.dedup_content(t.documents.select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "content_hash")


@query(
    "distinct_visitors",
    """
WITH known AS (SELECT user_id, max(ts) AS last_seen, count(*) AS visits FROM events WHERE event_type = 'signup' AND user_id % 2 = 0 GROUP BY 1),
batch AS (SELECT user_id, ts AS last_seen, 1::BIGINT AS visits FROM events WHERE event_type = 'view' AND user_id % 3 = 0
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
SELECT * FROM known WHERE user_id NOT IN (SELECT user_id FROM batch) UNION ALL SELECT * FROM batch
""",
)
def _distinct_visitors(t: Tables) -> DataFrame:
    known = t.events.where("event_type = 'signup' AND user_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("visits"))
    visits = t.events.where("event_type = 'view' AND user_id % 3 = 0").select("user_id", F.col("ts").alias("last_seen"), F.lit(1).cast("bigint").alias("visits"))
    return records.distinct_visitors(visits, known, "user_id", "last_seen")


@query(
    "iso_timestamps",
    "SELECT event_id, ts AS created_at, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS updated_at, event_type AS closed_at FROM events",
)
def _iso_timestamps(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        F.col("event_type").alias("closed_at"),
    )
    return times.iso_timestamps(rows)


@query(
    "message_id",
    """
WITH parts AS (
  SELECT event_id, [event_type, CAST(user_id % 8 AS VARCHAR), CASE WHEN value > 50 THEN '' ELSE CAST(user_id AS VARCHAR) END, CAST(event_id AS VARCHAR)] AS p FROM events)
SELECT event_id, sha256(array_to_string(list_transform(p, lambda x: length(x) || ':' || x), '')) AS message_id FROM parts
""",
)
def _message_id(t: Tables) -> DataFrame:
    key = F.when(F.col("value") > 50, None).otherwise(F.col("user_id"))
    return t.events.select("event_id", records.message_id(F.col("event_type"), F.col("user_id") % 8, key, F.col("event_id")).alias("message_id"))


@query(
    "parse_cursor_json",
    "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1",
)
def _parse_cursor_json(t: Tables) -> DataFrame:
    k = records.parse_cursor_json(F.col("props"), "$.k").cast("int").alias("k")
    return t.events.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
