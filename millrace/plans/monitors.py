"""Metric monitoring over events (time series), orders (charges) and lineitem."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import drill, monitor
from millrace.operators.monitor import Monitor
from millrace.operators.monitor_run import MonitorStore
from millrace.plans.registry import Tables, query
from millrace.session import new_folder

EXACT = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"

# Daily value of each event type: the metric history all monitor queries read.
HISTORY = f"""
history AS (
  SELECT event_type AS metric_name, 'app' AS source, 'events' AS table_name,
         {EXACT} AS metric_value, CAST(date_trunc('day', ts) AS TIMESTAMP) AS recorded_at
  FROM events GROUP BY event_type, date_trunc('day', ts)),
clock AS (SELECT max(recorded_at) AS now_at FROM history)
"""

COMPARE = """
judged AS (
  SELECT * FROM (VALUES
    ('view', 'week_over_week', 5.0), ('click', 'rolling_7day_avg', 10.0),
    ('purchase', 'rolling_30day_avg', 2.0), ('signup', 'prior_period', 15.0),
    ('error', 'prior_period', NULL)) AS j(metric_name, comparison_type, alert_threshold)),
base AS (
  SELECT metric_name,
         arg_max(metric_value, recorded_at) AS current_value,
         arg_min(metric_value, abs(epoch_us(recorded_at) - epoch_us(now_at - INTERVAL 7 DAY))) AS wow,
         avg(metric_value) FILTER (recorded_at >= now_at - INTERVAL 7 DAY) AS r7,
         avg(metric_value) FILTER (recorded_at >= now_at - INTERVAL 30 DAY) AS r30
  FROM history, clock GROUP BY metric_name),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY recorded_at DESC) AS nth FROM history),
line AS (
  SELECT metric_name, count(*) AS points, regr_slope(metric_value, -nth) AS slope, avg(metric_value) AS mean,
         max(CASE WHEN nth = 1 THEN metric_value END) AS last_value,
         max(CASE WHEN nth = 2 THEN metric_value END) AS prior_value
  FROM ranked WHERE nth <= 30 GROUP BY metric_name),
joined AS (
  SELECT j.*, b.current_value, l.points, l.slope, l.mean, l.last_value,
         CASE j.comparison_type WHEN 'week_over_week' THEN b.wow WHEN 'rolling_7day_avg' THEN b.r7
              WHEN 'rolling_30day_avg' THEN b.r30 ELSE l.prior_value END AS baseline_value
  FROM judged j JOIN base b USING (metric_name) JOIN line l USING (metric_name)),
compared AS (
  SELECT metric_name, comparison_type, current_value, baseline_value,
         (current_value - baseline_value) / abs(baseline_value) * 100 AS change_pct,
         coalesce(abs((current_value - baseline_value) / abs(baseline_value) * 100) >= alert_threshold, false)
           AS exceeds_threshold,
         CASE WHEN points >= 14 THEN slope END AS trend_slope,
         CASE WHEN points < 14 THEN NULL WHEN slope > abs(mean * 0.01) THEN 'increasing'
              WHEN slope < -abs(mean * 0.01) THEN 'decreasing' ELSE 'stable' END AS trend_direction,
         CASE WHEN points < 14 OR alert_threshold IS NULL OR slope = 0 OR mean = 0 THEN NULL
              WHEN abs(mean * alert_threshold / 100) - abs(last_value - mean) <= 0 THEN 0
              WHEN floor((abs(mean * alert_threshold / 100) - abs(last_value - mean)) / abs(slope)) > 0
              THEN CAST(least(floor((abs(mean * alert_threshold / 100) - abs(last_value - mean)) / abs(slope)), 365)
                   AS INTEGER) END AS forecast_threshold_days
  FROM joined)
"""

JUDGED = [
    ("view", "week_over_week", 5.0),
    ("click", "rolling_7day_avg", 10.0),
    ("purchase", "rolling_30day_avg", 2.0),
    ("signup", "prior_period", 15.0),
    ("error", "prior_period", None),
]


def exact_sum(column: str):
    """A sum of money that does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def history(t: Tables) -> DataFrame:
    return monitor.metric_series(t.events, "ts", F.col("event_type"), exact_sum("value"), "app", "events")


def clock(rows: DataFrame):
    return rows.agg(F.max("recorded_at")).scalar()


def judged(t: Tables) -> DataFrame:
    return monitor.settings(t.spark, [Monitor(n, "raw_app.events", "SUM(value)", None, c, a) for n, c, a in JUDGED])


def compared(t: Tables) -> DataFrame:
    rows = history(t)
    return monitor.monitor_compare(rows, judged(t), clock(rows))


def charge(t: Tables) -> DataFrame:
    """Orders as charges of a payments source."""
    return t.orders.select(
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("refunded"),
        F.col("o_orderpriority").alias("currency"),
        F.col("o_orderdate").alias("created"),
    )


CHARGE = """
charge AS (
  SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
         o_orderpriority = '1-URGENT' AS refunded, o_orderpriority AS currency, o_orderdate AS created
  FROM orders)
"""


@query(
    "metric_eval",
    f"""
WITH {CHARGE}
SELECT 'paid_total' AS metric_name, 'shop' AS source, 'charge' AS table_name,
       round(sum(amount)::DOUBLE / 100.0, 2) AS metric_value, false AS failed FROM charge WHERE status = 'succeeded'
UNION ALL SELECT 'paid_count', 'shop', 'charge', count(*)::DOUBLE, false FROM charge WHERE status = 'succeeded'
UNION ALL SELECT 'largest', 'shop', 'charge', max(amount)::DOUBLE, false FROM charge
UNION ALL SELECT 'no_column', 'shop', 'charge', NULL, true
UNION ALL SELECT 'by_zero', 'shop', 'charge', NULL, true
UNION ALL SELECT 'paid_share', 'shop', 'charge',
       round(count(*) FILTER (status = 'succeeded')::DOUBLE / count(*), 2), false FROM charge WHERE currency <> '5-LOW'
UNION ALL SELECT 'item_rows', 'shop', 'item', count(*)::DOUBLE, false FROM lineitem
""",
)
def _metric_eval(t: Tables) -> DataFrame:
    paid = "status = 'succeeded'"
    monitors = [
        Monitor("paid_total", "raw_shop.charge", "SUM(amount) / 100.0", paid),
        Monitor("paid_count", "raw_shop.charge", "COUNT(*)", paid),
        Monitor("largest", "raw_shop.charge", "MAX(amount)"),
        Monitor("no_column", "raw_shop.charge", "SUM(absent)"),
        Monitor("by_zero", "raw_shop.charge", "SUM(amount / (amount - amount))"),
        Monitor("paid_share", "raw_shop.charge", "COUNT(CASE WHEN status = 'succeeded' THEN 1 END) / COUNT(*)", "currency <> '5-LOW'"),
        Monitor("item_rows", "raw_shop.item", "COUNT(*)"),
    ]
    values = monitor.metric_eval(t.spark, {"raw_shop.charge": charge(t), "raw_shop.item": t.lineitem}, monitors, F.current_timestamp())
    return values.select(
        "metric_name", "source", "table_name", F.round("metric_value", 2).alias("metric_value"), F.col("error").isNotNull().alias("failed")
    )


@query(
    "metric_presets",
    f"""
WITH {CHARGE},
traffic AS (
  SELECT event_type AS session_source, count(*) AS sessions, count(*) FILTER (value > 50) AS engaged_sessions,
         CAST(max(value) AS DECIMAL(18,2)) AS bounce_rate,
         CAST(min(value) AS DECIMAL(18,2)) AS average_session_duration
  FROM events GROUP BY event_type, user_id)
SELECT 'shop_daily_revenue' AS metric_name, 'week_over_week' AS comparison_type, 20.0::DOUBLE AS alert_threshold,
       round(sum(amount)::DOUBLE / 100.0, 4) AS metric_value FROM charge WHERE status = 'succeeded'
UNION ALL SELECT 'shop_new_customers', 'week_over_week', 25.0, count(*)::DOUBLE FROM customer
UNION ALL SELECT 'shop_refund_rate', 'rolling_7day_avg', 50.0,
       round(count(CASE WHEN refunded THEN 1 END)::DOUBLE * 100.0 / nullif(count(*), 0), 4) FROM charge
UNION ALL SELECT 'shop_avg_order_value', 'rolling_7day_avg', 15.0, round(avg(amount) / 100.0, 4)
       FROM charge WHERE status = 'succeeded'
UNION ALL SELECT 'web_daily_sessions', 'week_over_week', 20.0, sum(sessions)::DOUBLE FROM traffic
UNION ALL SELECT 'web_bounce_rate', 'rolling_7day_avg', 25.0, round(avg(bounce_rate)::DOUBLE, 4) FROM traffic
UNION ALL SELECT 'web_avg_session_duration', 'rolling_7day_avg', 20.0, round(avg(average_session_duration)::DOUBLE, 4) FROM traffic
UNION ALL SELECT 'erp_lineitem_row_count', 'week_over_week', 25.0, count(*)::DOUBLE FROM lineitem
UNION ALL SELECT 'erp_part_row_count', 'week_over_week', 25.0, count(*)::DOUBLE FROM part
""",
)
def _metric_presets(t: Tables) -> DataFrame:
    traffic = t.events.groupBy(F.col("event_type").alias("session_source"), "user_id").agg(
        F.count_if(F.col("value") > 50).alias("engaged_sessions"),
        F.count(F.lit(1)).alias("sessions"),
        F.max("value").cast("decimal(18,2)").alias("bounce_rate"),
        F.min("value").cast("decimal(18,2)").alias("average_session_duration"),
    )
    tables = {
        "raw_shop.charge": charge(t),
        "raw_shop.customer": t.customer,
        "raw_web.traffic": traffic,
        "raw_erp.lineitem": t.lineitem,
        "raw_erp.part": t.part,
    }
    monitors = (
        monitor.payments_monitors("shop")
        + monitor.traffic_monitors("web", traffic.columns)
        + monitor.row_count_monitors("erp", ["part", "lineitem"])
    )
    values = monitor.metric_eval(t.spark, tables, monitors, F.current_timestamp())
    return values.join(monitor.settings(t.spark, monitors).drop("source", "table_name"), "metric_name").select(
        "metric_name", "comparison_type", "alert_threshold", F.round("metric_value", 4).alias("metric_value")
    )


@query("baseline_wow", f"WITH {HISTORY} SELECT metric_name, arg_min(metric_value, abs(epoch_us(recorded_at) - epoch_us(now_at - INTERVAL 7 DAY))) AS baseline_value FROM history, clock GROUP BY 1")
def _baseline_wow(t: Tables) -> DataFrame:
    rows = history(t)
    return monitor.baseline_wow(rows, clock(rows))


@query(
    "baseline_rolling",
    f"""
WITH {HISTORY}
SELECT metric_name, 7 AS n_days, round(avg(metric_value), 6) AS baseline_value FROM history, clock
WHERE recorded_at >= now_at - INTERVAL 7 DAY GROUP BY 1
UNION ALL
SELECT metric_name, 30, round(avg(metric_value), 6) FROM history, clock
WHERE recorded_at >= now_at - INTERVAL 30 DAY GROUP BY 1
""",
)
def _baseline_rolling(t: Tables) -> DataFrame:
    rows = history(t)
    both = [monitor.baseline_rolling(rows, clock(rows), n).withColumn("n_days", F.lit(n)) for n in (7, 30)]
    return both[0].unionByName(both[1]).withColumn("baseline_value", F.round("baseline_value", 6))


@query(
    "baseline_prior",
    f"""
WITH {HISTORY}
SELECT metric_name, metric_value AS baseline_value FROM history
QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY recorded_at DESC) = 2
""",
)
def _baseline_prior(t: Tables) -> DataFrame:
    return monitor.baseline_prior(history(t))


@query(
    "change_pct",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, l_discount,
       (l_tax - l_discount) / nullif(abs(l_discount), 0) * 100 AS change_pct FROM lineitem
""",
)
def _change_pct(t: Tables) -> DataFrame:
    # The rate now (tax) against its baseline (discount), which is 0 for a part of the lines.
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount",
        monitor.change_pct(F.col("l_tax"), F.col("l_discount")).alias("change_pct"),
    )


@query(
    "threshold_flag",
    """
SELECT l_returnflag, coalesce(abs((l_tax - l_discount) / nullif(abs(l_discount), 0) * 100) >= CASE WHEN l_linestatus = 'O' THEN 50.0 END, false)
         AS exceeds_threshold, count(*) AS n
FROM lineitem GROUP BY ALL
""",
)
def _threshold_flag(t: Tables) -> DataFrame:
    change = monitor.change_pct(F.col("l_tax"), F.col("l_discount"))
    limit = F.when(F.col("l_linestatus") == "O", F.lit(50.0))
    return (
        t.lineitem.groupBy("l_returnflag", monitor.threshold_flag(change, limit).alias("exceeds_threshold"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "trend",
    f"""
WITH {HISTORY}, {COMPARE}
SELECT metric_name, points, round(slope, 6) AS trend_slope,
       CASE WHEN slope > abs(mean * 0.01) THEN 'increasing' WHEN slope < -abs(mean * 0.01) THEN 'decreasing'
            ELSE 'stable' END AS trend_direction
FROM line
""",
)
def _trend(t: Tables) -> DataFrame:
    return monitor.trend(history(t)).select("metric_name", "points", F.round("trend_slope", 6).alias("trend_slope"), "trend_direction")


@query(
    "forecast_days",
    f"WITH {HISTORY}, {COMPARE} SELECT metric_name, trend_direction, forecast_threshold_days FROM compared",
)
def _forecast_days(t: Tables) -> DataFrame:
    return compared(t).select("metric_name", "trend_direction", "forecast_threshold_days")


@query(
    "monitor_compare",
    f"""
WITH {HISTORY}, {COMPARE}
SELECT metric_name, comparison_type, current_value, round(baseline_value, 6) AS baseline_value,
       round(change_pct, 6) AS change_pct, exceeds_threshold, round(trend_slope, 6) AS trend_slope,
       trend_direction, forecast_threshold_days FROM compared
""",
)
def _monitor_compare(t: Tables) -> DataFrame:
    return compared(t).select(
        "metric_name", "comparison_type", "current_value", F.round("baseline_value", 6).alias("baseline_value"),
        F.round("change_pct", 6).alias("change_pct"), "exceeds_threshold", F.round("trend_slope", 6).alias("trend_slope"),
        "trend_direction", "forecast_threshold_days",
    )


STATUS = """
CASE WHEN exceeds_threshold THEN 'flagged' WHEN trend_direction <> 'stable' THEN 'trending' ELSE 'normal' END
"""


@query(
    "monitor_categorize",
    f"""
WITH {HISTORY}, {COMPARE}
SELECT metric_name AS name, {STATUS} AS status, current_value AS value, round(change_pct, 6) AS change_pct,
       CASE {STATUS} WHEN 'flagged' THEN 1 WHEN 'trending' THEN 2 ELSE 3 END AS urgency,
       round(coalesce(abs(change_pct), 0), 6) AS size
FROM compared
""",
)
def _monitor_categorize(t: Tables) -> DataFrame:
    values = monitor.newest(history(t), 1).withColumn("error", F.lit(None).cast("string"))
    out = monitor.monitor_categorize(values, compared(t))
    # What the report is ordered by is checked too.
    rank = F.array_position(F.array(*[F.lit(s) for s in monitor.STATUS_ORDER]), F.col("status")).cast("int")
    size = F.round(F.coalesce(F.abs("change_pct"), F.lit(0.0)), 6)
    return out.select("name", "status", "value", F.round("change_pct", 6).alias("change_pct"), rank.alias("urgency"), size.alias("size"))


@query(
    "monitor_summary",
    f"""
WITH {HISTORY}, {COMPARE},
top AS (SELECT metric_name, change_pct FROM compared WHERE exceeds_threshold ORDER BY abs(change_pct) DESC, metric_name LIMIT 3),
parts AS (
  SELECT (SELECT count(*) FROM compared WHERE exceeds_threshold) AS f,
         (SELECT count(*) FROM compared WHERE NOT exceeds_threshold AND trend_direction <> 'stable') AS t,
         (SELECT count(*) FROM compared) AS n,
         (SELECT string_agg(metric_name || ' ' || CASE WHEN change_pct > 0 THEN '+' ELSE '' END || printf('%.1f%%', change_pct), ', '
                 ORDER BY abs(change_pct) DESC, metric_name) FROM top) AS names)
SELECT coalesce(nullif(concat_ws(', ', CASE WHEN f > 0 THEN f || ' flagged (' || names || ')' END,
                CASE WHEN t > 0 THEN t || ' trending' END), ''), 'No issues') || '. ' || n || ' total.' AS summary
FROM parts
""",
)
def _monitor_summary(t: Tables) -> DataFrame:
    values = monitor.newest(history(t), 1).withColumn("error", F.lit(None).cast("string"))
    return monitor.monitor_summary(monitor.monitor_categorize(values, compared(t)))


@query(
    "metric_history_window",
    f"""
WITH {HISTORY}
SELECT h.* FROM history h, clock WHERE recorded_at >= now_at - INTERVAL 14 DAY
ORDER BY recorded_at DESC, metric_name LIMIT 1000
""",
)
def _metric_history_window(t: Tables) -> DataFrame:
    rows = history(t)
    return monitor.metric_history_window(rows, clock(rows), 14, limit=1000)


def stored_results(t: Tables) -> DataFrame:
    """Comparisons of earlier runs (each day against the day before) and drill-down rows in between."""
    at_time = Window.partitionBy("metric_name").orderBy("recorded_at")
    rows = history(t).withColumn("baseline_value", F.lag("metric_value").over(at_time))
    change = monitor.change_pct(F.col("metric_value"), F.col("baseline_value"))
    results = rows.select(
        "metric_name",
        F.lit("prior_period").alias("result_type"),
        "baseline_value",
        change.alias("change_pct"),
        monitor.threshold_flag(change, F.lit(10.0)).alias("exceeds_threshold"),
        F.lit("stable").alias("trend_direction"),
        F.lit(None).cast("int").alias("forecast_days"),
        F.col("recorded_at").alias("computed_at"),
    )
    drilled = results.withColumn("result_type", F.lit("drill_down:user_id")).withColumn(
        "computed_at", F.col("computed_at") + F.make_dt_interval(hours=F.lit(1))
    )
    return results.unionByName(drilled)


@query(
    "metric_latest",
    f"""
WITH {HISTORY},
lagged AS (
  SELECT *, lag(metric_value) OVER (PARTITION BY metric_name ORDER BY recorded_at) AS baseline_value FROM history)
SELECT metric_name AS name, metric_value AS value, baseline_value,
       round((metric_value - baseline_value) / abs(baseline_value) * 100, 6) AS change_pct,
       CASE WHEN abs((metric_value - baseline_value) / abs(baseline_value) * 100) >= 10 THEN 'flagged' ELSE 'normal' END AS status,
       'prior_period' AS comparison_type
FROM lagged QUALIFY rank() OVER (PARTITION BY metric_name ORDER BY recorded_at DESC) = 1
""",
)
def _metric_latest(t: Tables) -> DataFrame:
    out = monitor.metric_latest(history(t), stored_results(t))
    return out.select("name", "value", "baseline_value", F.round("change_pct", 6).alias("change_pct"), "status", "comparison_type")


SALES = Monitor("sales", "raw_shop.item", "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)", None, "prior_period", 5.0, ("l_returnflag", "l_suppkey"))


@query(
    "drill_breakdown",
    """
WITH grouped AS (
  SELECT 'l_returnflag' AS dimension, l_returnflag AS group_value,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 2
  UNION ALL
  SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
  FROM lineitem GROUP BY 2)
SELECT 'sales' AS metric_name, dimension, group_value, value FROM grouped
""",
)
def _drill_breakdown(t: Tables) -> DataFrame:
    return drill.drill_breakdown(t.lineitem, SALES)


SNAPSHOTS = """
snapshots AS (
  SELECT 'sales_' || l_returnflag AS metric_name, 'l_partkey' AS dimension,
         CASE WHEN l_partkey % 10 > 0 THEN CAST(l_partkey AS VARCHAR) END AS group_value,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
         CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS computed_at
  FROM lineitem GROUP BY 1, 3, 5),
newest AS (SELECT * FROM snapshots QUALIFY rank() OVER (PARTITION BY metric_name ORDER BY computed_at DESC) = 1)
"""


def snapshots(t: Tables) -> DataFrame:
    """One stored breakdown per metric and year; every tenth part has no name and shares the NULL group."""
    year = F.date_trunc("year", F.col("l_shipdate")).cast("timestamp_ntz")
    group = F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey").cast("string"))
    return (
        t.lineitem.groupBy(F.concat(F.lit("sales_"), "l_returnflag").alias("metric_name"), group.alias("group_value"), year.alias("computed_at"))
        .agg(exact_sum("l_extendedprice").alias("value"))
        .select("metric_name", F.lit("l_partkey").alias("dimension"), "group_value", "value", "computed_at")
    )


@query("drill_snapshot", f"WITH {SNAPSHOTS} SELECT * FROM newest")
def _drill_snapshot(t: Tables) -> DataFrame:
    return drill.drill_snapshot(snapshots(t))


@query(
    "drill_contributors",
    f"""
WITH {SNAPSHOTS},
old AS (SELECT * FROM snapshots WHERE computed_at < (SELECT max(computed_at) FROM snapshots)
        QUALIFY rank() OVER (PARTITION BY metric_name ORDER BY computed_at DESC) = 1),
both_sides AS (
  SELECT coalesce(c.metric_name, o.metric_name) AS metric_name, coalesce(c.group_value, o.group_value) AS group_value,
         coalesce(c.value, 0) AS current_value, o.value AS previous_value
  FROM newest c FULL JOIN old o ON c.metric_name = o.metric_name AND c.group_value IS NOT DISTINCT FROM o.group_value)
SELECT metric_name, 'l_partkey' AS dimension, group_value, current_value, previous_value,
       round(current_value - previous_value, 4) AS change_abs,
       round((current_value - previous_value) / nullif(abs(previous_value), 0) * 100, 6) AS change_pct
FROM both_sides QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY coalesce(abs(current_value - previous_value), 0) DESC, group_value NULLS FIRST) <= 3
""",
)
def _drill_contributors(t: Tables) -> DataFrame:
    stored = snapshots(t)
    last = stored.agg(F.max("computed_at")).scalar()
    earlier = stored.where(F.col("computed_at") < last)
    out = drill.drill_contributors(drill.drill_snapshot(stored), drill.drill_snapshot(earlier))
    return out.select(
        "metric_name", "dimension", "group_value", "current_value", "previous_value",
        F.round("change_abs", 4).alias("change_abs"), F.round("change_pct", 6).alias("change_pct"),
    )


@query(
    "run_monitors",
    f"""
WITH {HISTORY}, {COMPARE},
per_user AS (
  SELECT event_type AS metric_name, CAST(user_id AS VARCHAR) AS group_value,
         {EXACT} AS value, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day
  FROM events GROUP BY 1, 2, 4),
today AS (SELECT p.* FROM per_user p, clock WHERE day = now_at),
before AS (SELECT p.* FROM per_user p, clock WHERE day = now_at - INTERVAL 1 DAY),
moved AS (
  SELECT coalesce(a.metric_name, b.metric_name) AS metric_name, coalesce(a.group_value, b.group_value) AS group_value,
         coalesce(a.value, 0) - b.value AS change_abs
  FROM today a FULL JOIN before b ON a.metric_name = b.metric_name AND a.group_value IS NOT DISTINCT FROM b.group_value),
first AS (
  SELECT * FROM moved QUALIFY row_number() OVER (
    PARTITION BY metric_name ORDER BY coalesce(abs(change_abs), 0) DESC, group_value NULLS FIRST) = 1)
SELECT c.metric_name AS name, {STATUS} AS status, current_value AS value, comparison_type,
       round(baseline_value, 6) AS baseline_value, round(change_pct, 6) AS change_pct, exceeds_threshold,
       trend_direction, forecast_threshold_days, 'app' AS source, 'events' AS table_name,
       CASE WHEN exceeds_threshold THEN f.group_value END AS top_group,
       CASE WHEN exceeds_threshold THEN round(f.change_abs, 4) END AS top_change
FROM compared c LEFT JOIN first f ON c.metric_name = f.metric_name
""",
)
def _run_monitors(t: Tables) -> DataFrame:
    # The last day is what the monitors measure now; the days before are in the store, as is yesterday's breakdown.
    rows = history(t)
    today = rows.agg(F.max("recorded_at")).first()[0]
    events = t.events.withColumn("day", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))
    total = "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"
    monitors = [Monitor(n, "raw_app.events", total, f"event_type = '{n}'", c, a, ("user_id",)) for n, c, a in JUDGED]
    store = MonitorStore(t.spark, new_folder(t.spark, "monitors"))
    if today is not None:
        store.history_table.append(rows.where(F.col("recorded_at") < today))
        yesterday = events.where(F.col("day") == monitor.moment(today) - monitor.days(1))
        snapshots = [drill.stamp_snapshot(drill.drill_breakdown(yesterday, m), monitor.moment(today) - monitor.days(1)) for m in monitors]
        store.snapshots_table.append(reduce(DataFrame.unionByName, snapshots))
    run = store.run({"raw_app.events": events.where(F.col("day") == monitor.moment(today))}, monitors, monitor.moment(today), sources=["app"])
    # What the store holds now is the report; the largest contributor stands beside a flagged metric.
    results = monitor.metric_latest(store.history(), store.results())
    top = run.contributors.where("rank = 1").select(
        F.col("metric_name").alias("name"), F.col("group_value").alias("top_group"), F.round("change_abs", 4).alias("top_change")
    )
    return results.join(top, "name", "left").select(
        "name", "status", "value", "comparison_type", F.round("baseline_value", 6).alias("baseline_value"),
        F.round("change_pct", 6).alias("change_pct"), "exceeds_threshold", "trend_direction",
        "forecast_threshold_days", "source", "table_name", "top_group", "top_change",
    )
