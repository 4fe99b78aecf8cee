"""Loading: dispositions, guards and incremental reads, with orders and lineitem as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import load, quality
from millrace.plans.registry import Tables, query
from millrace.session import new_folder
from millrace.sources.store import KeyedTable, VersionedTable, merge_partitions

SPLIT = "2000-01-01"


def stored(t: Tables, label: str) -> VersionedTable:
    return VersionedTable(t.spark, new_folder(t.spark, label))


@query("write_append", "SELECT * FROM orders")
def _write_append(t: Tables) -> DataFrame:
    table = stored(t, "append")
    table.append(t.orders.where(F.col("o_orderdate") < SPLIT))
    table.append(t.orders.where(F.col("o_orderdate") >= SPLIT))
    return table.read()


SHIPPED = """
amounts AS (SELECT o_orderkey AS id, o_totalprice AS amount, o_orderdate AS seen_at FROM orders),
shipped AS (SELECT l_orderkey * 2 AS id, l_extendedprice AS amount, l_shipdate AS seen_at, l_linenumber FROM lineitem),
fresh AS (SELECT id, amount, seen_at FROM shipped
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, amount) = 1)
"""


def amounts(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("seen_at"))


def shipped(t: Tables) -> DataFrame:
    """A batch with several rows per key, for known and for new keys."""
    return t.lineitem.select((F.col("l_orderkey") * 2).alias("id"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("seen_at"))


@query(
    "write_merge",
    f"WITH {SHIPPED} SELECT * FROM amounts WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh",
)
def _write_merge(t: Tables) -> DataFrame:
    table = KeyedTable(t.spark, new_folder(t.spark, "merge"), ["id"], buckets=16)
    table.merge(amounts(t))
    table.merge(shipped(t), ["seen_at"])
    return table.read()


@query(
    "write_delete_insert_buckets",
    """
WITH batch AS (SELECT ps AS l_suppkey, CAST(0 AS BIGINT) AS l_partkey, bal AS l_extendedprice
               FROM (SELECT s_suppkey AS ps, s_acctbal AS bal FROM supplier WHERE s_acctbal < 5000))
SELECT l_suppkey, l_partkey, l_extendedprice FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM batch)
UNION ALL SELECT * FROM batch
""",
)
def _write_delete_insert_buckets(t: Tables) -> DataFrame:
    table = KeyedTable(t.spark, new_folder(t.spark, "delete_insert"), ["l_suppkey"], buckets=16)
    table.delete_insert(t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice"))
    fresh = t.supplier.where("s_acctbal < 5000")
    table.delete_insert(
        fresh.select(F.col("s_suppkey").alias("l_suppkey"), F.lit(0).cast("bigint").alias("l_partkey"), F.col("s_acctbal").alias("l_extendedprice"))
    )
    return table.read()


@query(
    "write_merge_partitions",
    """
WITH batch AS (SELECT o_orderkey, round(o_totalprice * 2, 2) AS o_totalprice, o_orderpriority FROM orders
               WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F')
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch)
UNION ALL SELECT * FROM batch
""",
)
def _write_merge_partitions(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "partitions")
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    t.orders.select(*columns).write.partitionBy("o_orderpriority").parquet(path)
    late = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F"))
    batch = late.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"), "o_orderpriority")
    merge_partitions(t.spark, path, batch, ["o_orderkey"], "o_orderpriority")
    return t.spark.read.schema(t.orders.select(*columns).schema).parquet(path)


@query("write_replace", "SELECT * FROM customer")
def _write_replace(t: Tables) -> DataFrame:
    table = stored(t, "replace")
    table.replace(t.customer.withColumn("c_acctbal", F.lit(0.0)))
    table.replace(t.customer)
    return table.read()


@query(
    "write_delete_insert",
    """
WITH batch AS (SELECT s_suppkey AS l_suppkey, CAST(0 AS BIGINT) AS l_partkey, s_acctbal AS l_extendedprice FROM supplier WHERE s_acctbal < 5000)
SELECT l_suppkey, l_partkey, l_extendedprice FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM batch)
UNION ALL SELECT * FROM batch
""",
)
def _write_delete_insert(t: Tables) -> DataFrame:
    target = t.lineitem.select("l_suppkey", "l_partkey", "l_extendedprice")
    batch = t.supplier.where("s_acctbal < 5000").select(
        F.col("s_suppkey").alias("l_suppkey"), F.lit(0).cast("bigint").alias("l_partkey"), F.col("s_acctbal").alias("l_extendedprice")
    )
    return load.write_delete_insert(target, batch, ["l_suppkey"])


@query(
    "empty_replace_guard",
    """
SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS live_rows,
       (SELECT count(*) FROM customer WHERE c_acctbal > 1e9) AS staged_rows, 'keep_old' AS action
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 'swap'
UNION ALL SELECT 'part', 0, (SELECT count(*) FROM part), 'swap'
""",
)
def _empty_replace_guard(t: Tables) -> DataFrame:
    live = {"customer": t.customer, "orders": t.orders}
    staged = {"customer": t.customer.where("c_acctbal > 1e9"), "orders": t.orders.where("o_orderstatus = 'F'"), "part": t.part}
    return load.empty_replace_guard(load.count_versions(live, staged))


@query(
    "table_truncation_guard",
    """
WITH b AS (SELECT o_orderpriority || '_' || year(o_orderdate) AS table_name, count(*) AS n FROM orders GROUP BY 1),
a AS (SELECT o_orderpriority || '_' || year(o_orderdate) AS table_name, count(*) FILTER (o_totalprice > 495000) AS n FROM orders GROUP BY 1)
SELECT table_name, b.n AS rows_before FROM b LEFT JOIN a USING (table_name) WHERE b.n > 0 AND coalesce(a.n, 0) = 0
""",
)
def _table_truncation_guard(t: Tables) -> DataFrame:
    name = F.concat_ws("_", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("table_name")
    before = t.orders.groupBy(name).agg(F.count(F.lit(1)).alias("row_count"))
    after = t.orders.where("o_totalprice > 495000").groupBy(name).agg(F.count(F.lit(1)).alias("row_count"))
    return load.table_truncation_guard(before, after)


LOADS = """
loads AS (
  SELECT 'u' || user_id AS source, ts AS timestamp,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status,
         CAST(floor(value) AS BIGINT) AS rows_processed,
         CAST(CASE WHEN event_type = 'view' THEN 0 ELSE floor(value * 2) END AS BIGINT) AS total_row_count,
         event_type = 'purchase' AS full_refresh, CAST(ts AS DATE) AS start_date FROM events)
"""


def loads(t: Tables) -> DataFrame:
    """Events as the load history of one source per user."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("success")
    return t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.col("ts").alias("timestamp"),
        status.alias("status"),
        F.floor("value").alias("rows_processed"),
        F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.floor(F.col("value") * 2)).cast("bigint").alias("total_row_count"),
        (F.col("event_type") == "purchase").alias("full_refresh"),
        F.to_date("ts").alias("start_date"),
    )


@query(
    "row_count_anomaly",
    f"""
WITH {LOADS},
last AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp DESC) AS n FROM loads),
prev AS (
  SELECT source, CASE WHEN total_row_count > 0 THEN total_row_count ELSE rows_processed END AS previous_rows
  FROM last WHERE n <= 5 AND status = 'success' AND (total_row_count > 0 OR rows_processed > 0)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY n) = 1),
totals AS (SELECT 'u' || user_id AS source, count(*) FILTER (event_type = 'click' AND value < 60) AS total_rows FROM events GROUP BY 1)
SELECT source, total_rows, previous_rows,
       CASE WHEN total_rows = 0 THEN 'error' WHEN total_rows / previous_rows < 0.5 OR total_rows / previous_rows > 3 THEN 'warning' ELSE 'none' END AS level
FROM totals JOIN prev USING (source)
""",
)
def _row_count_anomaly(t: Tables) -> DataFrame:
    source = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source")
    small = F.count_if((F.col("event_type") == "click") & (F.col("value") < 60))
    return load.row_count_anomaly(t.events.groupBy(source).agg(small.alias("total_rows")), loads(t))


@query(
    "data_loss_check",
    f"""
WITH {LOADS}, lagged AS (SELECT *, lag(total_row_count) OVER (PARTITION BY source ORDER BY timestamp) AS rows_before FROM loads)
SELECT source, timestamp, rows_before, total_row_count AS rows_after FROM lagged WHERE full_refresh AND total_row_count < rows_before
""",
)
def _data_loss_check(t: Tables) -> DataFrame:
    return load.data_loss_check(loads(t))


@query(
    "load_row_counts",
    """
WITH c AS (
  SELECT 'orders' AS table_name, count(*) FILTER (year(o_orderdate) = 2000) AS rows_loaded, count(*) AS total_rows FROM orders
  UNION ALL SELECT 'lineitem', count(*) FILTER (year(l_shipdate) = 2000), count(*) FROM lineitem)
SELECT * FROM c UNION ALL SELECT '__total__', CAST(sum(rows_loaded) AS BIGINT), CAST(sum(total_rows) AS BIGINT) FROM c
""",
)
def _load_row_counts(t: Tables) -> DataFrame:
    # A load per year stands for the load id.
    tables = {"orders": t.orders.withColumn("_load_id", F.year("o_orderdate")), "lineitem": t.lineitem.withColumn("_load_id", F.year("l_shipdate"))}
    return load.load_row_counts(tables, "_load_id", 2000)


@query(
    "empty_with_schema",
    """
SELECT 'charge' AS endpoint, count(*) AS rows FROM orders WHERE o_orderstatus = 'none'
UNION ALL SELECT 'refund', count(*) FROM orders WHERE o_orderstatus = 'P'
""",
)
def _empty_with_schema(t: Tables) -> DataFrame:
    # One endpoint delivered nothing: its typed empty table takes part like the other.
    empty = load.empty_with_schema(t.spark, load.hinted_schema({"o_orderkey": "bigint", "o_totalprice": "double", "meta": "complex"}))
    refunds = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice", F.lit("{}").alias("meta"))
    counts = quality.row_counts_all({"charge": empty, "refund": refunds})
    return counts.select(F.col("table_name").alias("endpoint"), F.col("row_count").alias("rows"))


@query(
    "partial_load",
    """
SELECT 'orders' AS table_name, 'loaded' AS status, 'partial' AS load_status, count(*) AS row_count FROM orders
UNION ALL SELECT 'customer', 'loaded', 'partial', count(*) FROM customer
UNION ALL SELECT 'broken', 'failed', 'partial', NULL
""",
)
def _partial_load(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "partial")
    reads = {"orders": lambda: t.orders, "broken": lambda: t.orders.select("absent"), "customer": lambda: t.customer}
    done = load.partial_load(t.spark, reads, lambda name, df: df.write.parquet(f"{path}/{name}"))
    loaded = {n: t.spark.read.parquet(f"{path}/{n}") for n in ("orders", "customer")}
    return done.join(quality.row_counts_all(loaded), "table_name", "left").select("table_name", "status", "load_status", "row_count")


@query(
    "incremental_cursor",
    """
WITH r AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01' AND o_orderdate < TIMESTAMP '2000-06-01')
SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM r) AS last_value FROM r
""",
)
def _incremental_cursor(t: Tables) -> DataFrame:
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1999-06-01", "2000-06-01"))
    rows, state = load.incremental_cursor(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", start, end)
    return rows.withColumn("last_value", state.scalar())


@query(
    "cursor_alternatives",
    """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END,
       CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate - INTERVAL 1 DAY END, TIMESTAMP '1970-01-01') AS cursor_value FROM orders
""",
)
def _cursor_alternatives(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("time"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_sub("o_orderdate", 1).cast("timestamp_ntz")).alias("timestamp"),
        F.lit("1970-01-01").cast("timestamp_ntz").alias("created_at"),
    )
    return rows.select("o_orderkey", load.cursor_alternatives(["time", "timestamp", "created_at"]).alias("cursor_value"))


@query(
    "archive_skip",
    """
WITH archives AS (SELECT DISTINCT o_custkey AS player, strftime(o_orderdate, '%Y/%m') AS month FROM orders),
loaded AS (SELECT DISTINCT l_partkey AS player, strftime(l_shipdate, '%Y/%m') AS month FROM lineitem)
SELECT * FROM archives a WHERE month BETWEEN '1997/03' AND '2000/11'
AND NOT EXISTS (SELECT 1 FROM loaded l WHERE l.player = a.player AND l.month = a.month)
""",
)
def _archive_skip(t: Tables) -> DataFrame:
    archives = t.orders.select(F.col("o_custkey").alias("player"), F.date_format("o_orderdate", "yyyy/MM").alias("month")).distinct()
    loaded = t.lineitem.select(F.col("l_partkey").alias("player"), F.date_format("l_shipdate", "yyyy/MM").alias("month"))
    return load.archive_skip(archives, loaded, "1997/03", "2000/11")


@query(
    "incremental_lag",
    """
WITH target AS (SELECT o_orderkey AS id, o_orderdate AS seen_at, o_totalprice AS amount FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'),
again AS (SELECT o_orderkey AS id, o_orderdate AS seen_at, o_totalprice + 1 AS amount FROM orders
          WHERE o_orderdate >= (SELECT max(seen_at) FROM target) - INTERVAL 30 DAY)
SELECT * FROM target WHERE id NOT IN (SELECT id FROM again) UNION ALL SELECT * FROM again
""",
)
def _incremental_lag(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen_at"), F.col("o_totalprice").alias("amount"))
    target = rows.where(F.col("seen_at") < "2001-01-01")
    return load.incremental_lag(target, rows.withColumn("amount", F.col("amount") + 1), ["id"], "seen_at", 30)


@query(
    "clamp_start",
    """
SELECT o_custkey, CAST(greatest(CAST(max(o_orderdate) AS DATE) - 28, CAST(DATE '2001-08-01' - INTERVAL 37 MONTH AS DATE)) AS VARCHAR) AS start_date
FROM orders GROUP BY 1
""",
)
def _clamp_start(t: Tables) -> DataFrame:
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    start = load.clamp_start(F.col("last"), 28, F.lit("2001-08-01").cast("timestamp_ntz"))
    return last.select("o_custkey", start.cast("string").alias("start_date"))


@query(
    "date_range_filter",
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'",
)
def _date_range_filter(t: Tables) -> DataFrame:
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1998-01-01", "1999-01-01"))
    return load.date_range_filter(t.orders, "o_orderdate", start, end)


@query(
    "backfill_window",
    """
WITH d AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS VARCHAR) || CASE o_orderstatus WHEN 'F' THEN 'd' WHEN 'O' THEN 'W' ELSE 'x' END AS duration, o_orderdate FROM orders)
SELECT o_orderkey, duration, n_days, CAST(CAST(o_orderdate AS DATE) - n_days AS VARCHAR) AS start_date,
       o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY AS in_2m
FROM (SELECT *, CASE WHEN regexp_full_match(duration, '[1-9][0-9]*[dwmDWM]')
      THEN CAST(regexp_extract(duration, '^(\\d+)', 1) AS INTEGER) * CASE lower(right(duration, 1)) WHEN 'd' THEN 1 WHEN 'w' THEN 7 ELSE 30 END END AS n_days FROM d)
""".replace("\\\\", "\\"),
)
def _backfill_window(t: Tables) -> DataFrame:
    unit = F.when(F.col("o_orderstatus") == "F", "d").when(F.col("o_orderstatus") == "O", "W").otherwise("x")
    rows = t.orders.select("o_orderkey", F.concat((F.col("o_orderkey") % 40).cast("string"), unit).alias("duration"), "o_orderdate")
    kept = load.backfill_window(rows, "o_orderdate", "2m", F.lit("2001-08-01").cast("timestamp_ntz"))
    marked = rows.join(kept.select("o_orderkey", F.lit(True).alias("_in")), "o_orderkey", "left")
    n = load.backfill_days(F.col("duration"))
    return marked.select(
        "o_orderkey", "duration", n.alias("n_days"), F.date_sub(F.to_date("o_orderdate"), n).cast("string").alias("start_date"),
        F.coalesce("_in", F.lit(False)).alias("in_2m"),
    )


@query(
    "gap_fill",
    f"""
WITH {LOADS},
req AS (SELECT 'u' || user_id AS source, CAST(DATE '2024-01-01' + CAST(user_id % 4 AS INTEGER) AS DATE) AS start_date FROM events GROUP BY user_id),
e AS (SELECT source, min(start_date) AS gap_end FROM loads WHERE status = 'success' GROUP BY 1)
SELECT source, CAST(start_date AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end FROM req JOIN e USING (source) WHERE start_date < gap_end
""",
)
def _gap_fill(t: Tables) -> DataFrame:
    users = t.events.select("user_id").distinct()
    requests = users.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 4).cast("int")).alias("start_date"),
    )
    return load.gap_fill(requests, loads(t)).select("source", F.col("gap_start").cast("string"), F.col("gap_end").cast("string"))


@query(
    "route_by_key",
    """
SELECT regexp_replace(lower(lang || '_' || source), '[^a-z0-9]+', '_', 'g') AS route, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY 1
""",
)
def _route_by_key(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "routes")
    load.route_by_key(t.documents, load.route_name(F.col("lang"), F.col("source")), path)
    return t.spark.read.parquet(path).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "scan_pushdown",
    """
SELECT 'include' AS kind, o_orderkey, o_totalprice, NULL AS o_orderpriority FROM orders
UNION ALL SELECT 'exclude', o_orderkey, o_totalprice, o_orderpriority FROM orders
""",
)
def _scan_pushdown(t: Tables) -> DataFrame:
    wanted = load.scan_pushdown(t.orders, ["o_orderkey"], include=["o_totalprice"])
    others = load.scan_pushdown(t.orders, ["o_orderkey"], exclude=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    a = wanted.withColumn("kind", F.lit("include"))
    return a.unionByName(others.withColumn("kind", F.lit("exclude")), allowMissingColumns=True)
