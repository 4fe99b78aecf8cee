"""Staging, deduplication, history and models over orders, customer and lineitem."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import dedup, staging
from millrace.operators.staging import Model
from millrace.plans.registry import Tables, query
from millrace.session import new_folder


def raw_orders(t: Tables) -> DataFrame:
    """Orders as a loader leaves them, with bookkeeping columns and free-form names."""
    return t.orders.select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_totalprice").alias("Total--Price (EUR)"),
        F.col("o_orderdate").alias("Order Date"),
        F.col("o_orderdate").alias("start_date"),
        F.lit("x").alias("_load_id"),
        F.lit("y").alias("_src_file"),
    )


@query(
    "staging_projection",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price_eur, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, o_orderdate AS start_date FROM orders",
)
def _staging_projection(t: Tables) -> DataFrame:
    # As text, a date shows that it has no time any more.
    return staging.staging_projection(raw_orders(t)).withColumn("order_date", F.col("order_date").cast("string"))


@query(
    "staging_date_cast",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS \"order date\", o_orderdate AS start_date, o_orderdate AS updated FROM orders",
)
def _staging_date_cast(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    cast = staging.staging_date_cast(t.orders.select("o_orderkey", day.alias("order date"), day.alias("start_date"), day.alias("updated")))
    return cast.withColumn("order date", F.col("order date").cast("string"))


CHANGES = "changes AS (SELECT l_orderkey AS order_id, l_shipdate AS updated_at, l_linenumber AS line, l_quantity AS quantity FROM lineitem)"


def changes(t: Tables) -> DataFrame:
    """Lines as successive states of their order."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("updated_at"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")
    )


def dedup_sql(partition: str, order: str) -> str:
    return f"WITH {CHANGES} SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY {partition} ORDER BY {order}) = 1"


@query("dedup_last_modified", dedup_sql("order_id", "updated_at DESC, line, quantity"))
def _dedup_last_modified(t: Tables) -> DataFrame:
    rows = changes(t)
    key, modified = dedup.infer_dedup(rows.columns)
    return dedup.dedup_last_modified(rows, [key], modified)


@query("dedup_first_seen", dedup_sql("order_id", "updated_at, line, quantity"))
def _dedup_first_seen(t: Tables) -> DataFrame:
    return dedup.dedup_first_seen(changes(t), ["order_id"], "updated_at")


@query("dedup_composite_key", dedup_sql("order_id, line", "updated_at, quantity"))
def _dedup_composite_key(t: Tables) -> DataFrame:
    return dedup.dedup_composite_key(changes(t), ["order_id", "line"])


@query("dedup_row_number", dedup_sql("order_id", "quantity DESC, line, updated_at"))
def _dedup_row_number(t: Tables) -> DataFrame:
    return dedup.dedup_row_number(changes(t), ["order_id"], [F.desc("quantity"), F.col("line")])


@query("dedup_latest_only", dedup_sql("order_id", "updated_at DESC, line, quantity"))
def _dedup_latest_only(t: Tables) -> DataFrame:
    return dedup.apply_policy(changes(t), "latest_only")


@query("dedup_append_only", f"WITH {CHANGES} SELECT * FROM changes")
def _dedup_append_only(t: Tables) -> DataFrame:
    return dedup.apply_policy(changes(t), "append_only")


@query("dedup_none", f"WITH {CHANGES} SELECT * FROM changes")
def _dedup_none(t: Tables) -> DataFrame:
    return dedup.apply_policy(changes(t), "none")


@query(
    "scd2_timestamp",
    f"""
WITH {CHANGES},
a AS (SELECT * FROM changes WHERE updated_at < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, line, quantity) = 1),
b AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC, line, quantity) = 1)
SELECT a.*, a.updated_at AS valid_from, CASE WHEN b.updated_at > a.updated_at THEN b.updated_at END AS valid_to FROM a JOIN b USING (order_id)
UNION ALL
SELECT b.*, b.updated_at, NULL FROM b LEFT JOIN a USING (order_id) WHERE a.order_id IS NULL OR b.updated_at > a.updated_at
""",
)
def _scd2_timestamp(t: Tables) -> DataFrame:
    rows = changes(t)
    first = staging.scd2_timestamp(None, rows.where(F.col("updated_at") < "1998-01-01"), ["order_id"], "updated_at")
    second = staging.scd2_timestamp(first, rows, ["order_id"], "updated_at")
    # The same load again must change nothing.
    return staging.scd2_timestamp(second, rows, ["order_id"], "updated_at")


@query(
    "scd2_history",
    f"""
WITH {CHANGES},
once AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY order_id, updated_at ORDER BY line, quantity) = 1)
SELECT *, updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY order_id ORDER BY updated_at) AS valid_to FROM once
""",
)
def _scd2_history(t: Tables) -> DataFrame:
    return staging.scd2_history(changes(t), ["order_id"], "updated_at")


@query(
    "scd2_check",
    """
WITH a AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer),
b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer
      UNION ALL SELECT -1 - s_suppkey, 'SUPPLIER', s_acctbal FROM supplier)
SELECT a.*, TIMESTAMP '2024-01-01' AS valid_from,
       CASE WHEN b.c_mktsegment IS DISTINCT FROM a.c_mktsegment THEN TIMESTAMP '2024-01-02' END AS valid_to FROM a JOIN b USING (c_custkey)
UNION ALL
SELECT b.*, TIMESTAMP '2024-01-02', NULL FROM b LEFT JOIN a USING (c_custkey)
WHERE a.c_custkey IS NULL OR b.c_mktsegment IS DISTINCT FROM a.c_mktsegment
""",
)
def _scd2_check(t: Tables) -> DataFrame:
    first = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = first.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment")))
    others = t.supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal"))
    load = changed.unionByName(others)
    one = staging.scd2_check(None, first, ["c_custkey"], datetime(2024, 1, 1))
    two = staging.scd2_check(one, load, ["c_custkey"], datetime(2024, 1, 2))
    return staging.scd2_check(two, load, ["c_custkey"], datetime(2024, 1, 3))


@query(
    "stale_record_flag",
    "SELECT c_custkey, c_name, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01') AS is_stale FROM customer",
)
def _stale_record_flag(t: Tables) -> DataFrame:
    latest = t.orders.where(F.col("o_orderdate") >= "2001-07-01").select(F.col("o_custkey").alias("c_custkey"))
    return staging.stale_record_flag(t.customer.select("c_custkey", "c_name"), latest, ["c_custkey"])


@query("geo_enrich", "SELECT c.*, n_name AS nation, n_regionkey AS region_id FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 4")
def _geo_enrich(t: Tables) -> DataFrame:
    # The seed is a CSV file read with a declared schema.
    folder = new_folder(t.spark, "seed")
    t.nation.where("n_regionkey < 4").write.option("header", True).csv(folder)
    seed = t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").option("header", True).csv(folder)
    return staging.geo_enrich(t.customer, seed, "c_nationkey", "n_nationkey", {"n_name": "nation", "n_regionkey": "region_id"})


@query(
    "mart_rollup",
    """
SELECT upper(n_name) AS nation, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS facts,
       coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE), 0) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""",
)
def _mart_rollup(t: Tables) -> DataFrame:
    dim = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return staging.mart_rollup(dim, t.orders, "c_custkey", "o_custkey", F.col("n_name"), "nation", "o_totalprice")


@query(
    "run_models",
    """
SELECT c_mktsegment AS segment, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders
FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1
""",
)
def _run_models(t: Tables) -> DataFrame:
    models = [
        Model("segments", "SELECT c_mktsegment AS segment, count(*) AS customers, sum(n) AS orders FROM {stg_customer} JOIN {per_customer} ON c_custkey = o_custkey GROUP BY 1", ("stg_customer", "per_customer")),
        Model("per_customer", "SELECT o_custkey, count(*) AS n FROM {stg_orders} GROUP BY 1", ("stg_orders",)),
        Model("stg_orders", "SELECT o_orderkey, o_custkey FROM {orders}", ("orders",)),
        Model("stg_customer", "SELECT c_custkey, c_mktsegment FROM {customer}", ("customer",)),
    ]
    built, _ = staging.run_models(t.spark, models, {"orders": t.orders, "customer": t.customer}, select="orders+")
    return built["segments"]


@query(
    "query_select",
    """
WITH big AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_name, n, top, (SELECT count(*) > 10000 FROM big) AS truncated FROM big JOIN customer ON c_custkey = o_custkey ORDER BY top DESC, c_name LIMIT 10000
""",
)
def _query_select(t: Tables) -> DataFrame:
    sql = """
        WITH big AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
        SELECT c_name, n, top FROM big JOIN customer ON c_custkey = o_custkey ORDER BY top DESC, c_name
    """
    rows, more = staging.query_select(t.spark, sql, {"orders": t.orders, "customer": t.customer}, max_rows=10_000)
    return rows.withColumn("truncated", more.scalar())
