"""Lineage over the keys of the given tables, freshness over events as loads, and logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import drift, lineage, pii
from millrace.plans.governance import EVENTS, NOW, TABLES, both_schemas, scan_sql
from millrace.plans.loading import LOADS, loads
from millrace.plans.registry import Tables, query
from millrace.session import new_folder

# nation -> customer -> order and nation -> supplier -> order (a diamond); urgent orders
# depend on themselves (a cycle).
EDGES = """
edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
    UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
    UNION ALL SELECT 'supplier:' || l_suppkey, 'order:' || l_orderkey FROM lineitem
    UNION ALL SELECT 'order:' || o_orderkey, 'order:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))
"""


def name(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def edges(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    pairs = [
        (t.nation, name("region", "n_regionkey"), name("nation", "n_nationkey")),
        (t.customer, name("nation", "c_nationkey"), name("customer", "c_custkey")),
        (t.supplier, name("nation", "s_nationkey"), name("supplier", "s_suppkey")),
        (t.orders, name("customer", "o_custkey"), name("order", "o_orderkey")),
        (t.lineitem, name("supplier", "l_suppkey"), name("order", "l_orderkey")),
        (urgent, name("order", "o_orderkey"), name("order", "o_orderkey")),
    ]
    out = None
    for df, src, dst in pairs:
        part = df.select(src.alias("src"), dst.alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@query(
    "lineage_edges",
    """
SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'order:' || l_orderkey AS dst FROM lineitem
UNION SELECT 'part:' || l_partkey, 'order:' || l_orderkey FROM lineitem
""",
)
def _lineage_edges(t: Tables) -> DataFrame:
    nodes = t.lineitem.select(name("order", "l_orderkey").alias("node_id"), F.array(name("supplier", "l_suppkey"), name("part", "l_partkey")).alias("depends_on"))
    return lineage.lineage_edges(nodes)


@query(
    "lineage_nodes",
    f"""
WITH {EDGES},
nodes AS (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges),
tests AS (SELECT 'order:' || o_orderkey AS node_id, o_orderstatus IN ('F', 'O') AS passed FROM orders)
SELECT node_id, (SELECT count(*) FROM edges WHERE dst = node_id) AS depends_on_count, (SELECT count(*) FROM edges WHERE src = node_id) AS depended_on_by_count,
       (SELECT count(*) FROM tests t WHERE t.node_id = nodes.node_id) AS tests,
       (SELECT count(*) FROM tests t WHERE t.node_id = nodes.node_id AND passed) AS tests_passed
FROM nodes
""",
)
def _lineage_nodes(t: Tables) -> DataFrame:
    flow = edges(t)
    nodes = flow.select(F.explode(F.array("src", "dst")).alias("node_id"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pass").otherwise("fail")
    return lineage.lineage_nodes(nodes, flow, t.orders.select(name("order", "o_orderkey").alias("node_id"), status.alias("status")))


@query(
    "impact_tree",
    f"""
WITH RECURSIVE {EDGES},
walk AS (
  SELECT src AS root, dst AS node, [src, dst] AS path, src = dst AS is_cycle FROM edges WHERE src LIKE 'region:%'
  UNION ALL
  SELECT w.root, e.dst, list_append(w.path, e.dst), list_contains(w.path, e.dst) FROM walk w JOIN edges e ON w.node = e.src WHERE NOT w.is_cycle)
SELECT root, node, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, ' > ') AS path, is_cycle, len(path) = 2 AS is_direct FROM walk
""",
)
def _impact_tree(t: Tables) -> DataFrame:
    flow = edges(t)
    return lineage.impact_tree(flow, t.region.select(name("region", "r_regionkey").alias("node_id"))).withColumn("path", F.array_join("path", " > "))


@query(
    "impact_counts",
    f"""
WITH RECURSIVE {EDGES},
walk AS (
  SELECT src AS root, dst AS node, 1 AS depth FROM edges WHERE src LIKE 'region:%'
  UNION ALL
  SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE e.src <> e.dst)
SELECT root, node, count(*) AS paths, min(depth) AS shortest, max(depth) AS longest,
       node IN (SELECT src FROM edges WHERE src = dst) AS in_cycle
FROM walk GROUP BY root, node
""",
)
def _impact_counts(t: Tables) -> DataFrame:
    out = lineage.impact_counts(edges(t), t.region.select(name("region", "r_regionkey").alias("node_id")))
    return out.withColumn("paths", F.col("paths").cast("long"))


@query(
    "lineage_cycles",
    """
WITH RECURSIVE following AS (
  SELECT l_orderkey, l_partkey AS src,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
edges AS (
  SELECT src, dst FROM following WHERE dst IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY l_orderkey DESC, dst DESC) = 1),
reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
SELECT r.src AS node_id, min(r.dst) AS component FROM reach r JOIN reach b ON r.src = b.dst AND r.dst = b.src GROUP BY r.src
""",
)
def _lineage_cycles(t: Tables) -> DataFrame:
    # Each part points to the one that stood behind it on the newest order where one did.
    lines = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    behind = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(lines).alias("dst"))
    newest = F.max(F.struct("l_orderkey", "dst")).alias("last")
    return lineage.lineage_cycles(behind.where("dst IS NOT NULL").groupBy("src").agg(newest).select("src", "last.dst"))


@query(
    "stale_models",
    """
WITH m AS (SELECT 'order:' || o_orderkey AS node_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' END AS status, o_orderkey FROM orders),
failed AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)
SELECT node_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (FROM failed)) AND status IS DISTINCT FROM 'error' THEN 'stale' ELSE status END AS status FROM m
""",
)
def _stale_models(t: Tables) -> DataFrame:
    models = t.orders.select(name("order", "o_orderkey").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error").alias("status"))
    flow = t.lineitem.select(name("supplier", "l_suppkey").alias("src"), name("order", "l_orderkey").alias("dst"), F.col("l_suppkey").alias("source"))
    failed = t.supplier.where("s_acctbal < 1000").select(F.col("s_suppkey").alias("source"))
    return lineage.stale_models(models, flow, failed)


@query(
    "freshness",
    f"""
WITH {LOADS},
sources AS (SELECT DISTINCT 'u' || (c_custkey % 400) AS source FROM customer),
last AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY source ORDER BY timestamp DESC) = 1)
SELECT s.source, CASE WHEN l.status IS NULL THEN 'never_synced' WHEN l.status IN ('success', 'partial') THEN 'synced' ELSE 'failed' END AS status,
       CASE WHEN l.status IN ('success', 'partial') THEN round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(l.timestamp)) / 3600000000, 1) END AS hours_since_sync,
       l.timestamp AS last_sync_time, l.status AS last_sync_status
FROM sources s LEFT JOIN last l USING (source)
""",
)
def _freshness(t: Tables) -> DataFrame:
    sources = t.customer.select(F.concat(F.lit("u"), (F.col("c_custkey") % 400).cast("string")).alias("source")).distinct()
    return lineage.freshness(sources, loads(t), NOW)


@query(
    "staleness",
    f"""
WITH {LOADS},
gaps AS (SELECT source, timestamp, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY source ORDER BY timestamp))) / 3600000000 AS gap FROM loads),
s AS (SELECT source, coalesce(min(gap), 24) AS interval_hours, max(timestamp) AS last_load FROM gaps GROUP BY 1)
SELECT source, last_load, round(interval_hours, 6) AS interval_hours, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_load)) / 3600000000, 6) AS hours_since_load,
       (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_load)) / 3600000000 > 2 * interval_hours AS is_stale FROM s
""",
)
def _staleness(t: Tables) -> DataFrame:
    out = lineage.staleness(loads(t), datetime(2024, 1, 31))
    return out.withColumns({c: F.round(c, 6) for c in ("interval_hours", "hours_since_load")})


@query(
    "quality_summary",
    f"""
WITH {EVENTS}, found AS ({" UNION ALL ".join("(" + scan_sql(n, "web", c, None) + ")" for n, c in TABLES.items())}),
sources AS (SELECT DISTINCT CASE event_type WHEN 'error' THEN 'web' WHEN 'view' THEN 'app' ELSE 'shop' END AS source FROM events)
SELECT source, (SELECT count(*) FROM drifted d WHERE d.source = sources.source) AS drift_event_count,
       (SELECT count(*) FROM found f WHERE f.source = sources.source) AS pii_finding_count,
       (SELECT count(DISTINCT (table_name, column_name)) FROM found f WHERE f.source = sources.source) AS pii_column_count FROM sources
""",
)
def _quality_summary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    sources = t.events.select(F.when(kind == "error", "web").when(kind == "view", "app").otherwise("shop").alias("source"))
    found = None
    for table in TABLES:
        part = pii.pii_full_scan(getattr(t, table), "web", table, NOW)
        found = part if found is None else found.unionByName(part)
    return lineage.quality_summary(sources, drift.drift_events(*both_schemas(t)), found)


@query(
    "log_query",
    """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, 'core' AS category, event_type AS event, CAST(user_id AS VARCHAR) AS user_id
FROM events WHERE event_type IN ('view', 'purchase') AND strftime(ts, '%Y-%m-%d') >= '2024-01-10'
ORDER BY ts DESC, event_id LIMIT 500
""",
)
def _log_query(t: Tables) -> DataFrame:
    # Views name their category, purchases leave it out, clicks have another, lines of errors are cut off.
    kind = F.col("event_type")
    entry = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
            F.when(kind == "view", "core").when(kind.isin("click", "signup"), "other").alias("category"),
            kind.alias("event"),
            F.col("user_id").cast("string").alias("user_id"),
        )
    )
    line = F.when(kind == "error", F.substr(entry, F.lit(1), F.lit(30))).otherwise(entry)
    path = new_folder(t.spark, "log")
    t.events.select(line.alias("value")).write.text(path)
    rows = lineage.log_query(lineage.read_log(t.spark, path), category="core", since="2024-01-10", limit=500)
    return rows.select("timestamp", "category", "event", "user_id")
