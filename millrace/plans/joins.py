"""The joins, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans.registry import Tables, query


@query(
    "join_inner_latest",
    """
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate FROM orders o
JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) x ON o.o_custkey = x.o_custkey AND o.o_orderdate = x.m
""",
)
def _join_inner_latest(t: Tables) -> DataFrame:
    return joins.join_inner_latest(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query(
    "join_left_equi",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, p_name, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey",
)
def _join_left_equi(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    parts = t.part.where("p_size > 10").select("p_partkey", "p_name", "p_brand")
    return joins.join_left_equi(lines, parts, {"l_partkey": "p_partkey"}).drop("l_partkey")


@query(
    "join_full_outer_compare",
    """
WITH a AS (SELECT CASE WHEN o_custkey % 50 > 0 THEN o_custkey END AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT CASE WHEN o_custkey % 50 > 0 THEN o_custkey END AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT CASE WHEN a.v IS NOT NULL THEN a.k ELSE b.k END AS k, a.v AS current, b.v AS previous,
       CASE WHEN a.v IS NULL THEN 'removed' WHEN b.v IS NULL THEN 'added' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k
""",
)
def _join_full_outer_compare(t: Tables) -> DataFrame:
    key = F.when(F.col("o_custkey") % 50 > 0, F.col("o_custkey")).alias("k")
    paid = t.orders.where("o_orderstatus = 'F'").groupBy(key).agg(F.count(F.lit(1)).alias("v"))
    pending = t.orders.where("o_orderstatus = 'O'").groupBy(key).agg(F.count(F.lit(1)).alias("v"))
    return joins.join_full_outer_compare(paid, pending, ["k"], "v")


@query("join_anti", "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _join_anti(t: Tables) -> DataFrame:
    return joins.join_anti(t.documents, t.labels, ["doc_id"]).select(*t.documents.columns)


@query(
    "join_semi_select",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _join_semi_select(t: Tables) -> DataFrame:
    chosen = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.join_semi_select(t.orders.select("o_orderkey", "o_custkey"), chosen, "o_custkey")


@query(
    "join_nearest_time",
    """
WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS at_ FROM events)
SELECT user_id, value, ts AS at FROM events, m
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us(at_)), ts, value) = 1
""".replace("ts AS at ", 'ts AS "at" '),
)
def _join_nearest_time(t: Tables) -> DataFrame:
    week_ago = t.events.agg((F.max("ts") - F.make_dt_interval(F.lit(7))).alias("m")).scalar()
    return joins.join_nearest_time(t.events, ["user_id"], "ts", "value", week_ago)


@query(
    "join_map_lookup",
    "SELECT s_suppkey, s_nationkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2",
)
def _join_map_lookup(t: Tables) -> DataFrame:
    mapping = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"))
    return joins.join_map_lookup(t.supplier.select("s_suppkey", "s_nationkey"), mapping, "s_nationkey", "nation")


@query(
    "join_parent_child",
    """
SELECT c.conv_id, c.turn, c.role, c.text, p.turn AS parent_turn, p.role AS parent_role, p.text AS parent_text
FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id
JOIN (SELECT conv_id, min(turn) AS m FROM conversations GROUP BY 1) f ON p.conv_id = f.conv_id AND p.turn = f.m
WHERE c.turn <> p.turn
""",
)
def _join_parent_child(t: Tables) -> DataFrame:
    return joins.join_parent_child(t.conversations, "conv_id", "turn", ["role", "text"])
