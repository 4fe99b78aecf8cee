"""Dependencies between tables and models, how fresh sources are, and logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.monitor import micros, moment
from millrace.operators.timeline import previous_time
from millrace.session import materialize

# Intervals a source may miss before it is stale, and the interval (hours) of one
# whose rhythm is unknown.
STALE_INTERVALS = 2
FALLBACK_HOURS = 24
HOUR = 3_600_000_000


def lineage_edges(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) of nodes (node_id, depends_on array): data flows from src to dst."""
    return nodes.select(F.explode("depends_on").alias("src"), F.col("node_id").alias("dst")).distinct()


def lineage_nodes(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Every node with how many it depends on, how many depend on it, and its test results.

    The names themselves are the edge table: a list per node would be as long as the table for
    a node everything depends on. ``tests``: node_id, status.
    """
    up = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("depends_on_count"))
    down = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("depended_on_by_count"))
    status = F.when(F.col("status") == "success", "pass").otherwise(F.col("status"))
    checks = tests.groupBy("node_id").agg(F.count(F.lit(1)).alias("tests"), F.count_if(status == "pass").alias("tests_passed"))
    out = nodes.select("node_id").distinct()
    for part in (up, down, checks):
        out = out.join(part, "node_id", "left")
    return out.na.fill(0, ["depends_on_count", "depended_on_by_count", "tests", "tests_passed"])


def resolve_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a plain name; a model wins over a source of the same name. (node_id, name, kind)"""
    rank = F.when(F.col("kind") == "model", 0).otherwise(1)
    return nodes.where(F.col("name") == name).orderBy(rank, "node_id").limit(1)


def impact_tree(edges: DataFrame, roots: DataFrame, label: str = "impact", max_paths: int | None = None) -> DataFrame:
    """Every path down from the roots (``node_id``), one row per path: a diamond gives two.

    A path that meets itself ends there, marked as a cycle. One equi join per level; each level
    is written to the shared folder, so a lost executor repeats one level and the plan stays
    short. Stops at the first level without paths.

    Paths double with every diamond. ``max_paths`` bounds the report to the first so many, the shortest first and those of
    a length by their names; ``impact_counts`` tells how many there are without listing any.
    """
    flow = materialize(edges.select("src", "dst").distinct(), f"{label}-edges")
    level = roots.select(F.col("node_id").alias("root"), F.col("node_id").alias("node"), F.array("node_id").alias("path"), F.lit(False).alias("is_cycle"))
    out, left = None, max_paths
    while True:
        step = level.where(~F.col("is_cycle")).join(flow, F.col("node") == F.col("src"))
        level = materialize(
            step.select(
                "root",
                F.col("dst").alias("node"),
                F.concat("path", F.array("dst")).alias("path"),
                F.array_contains("path", F.col("dst")).alias("is_cycle"),
            ),
            label,
        )
        found = level.count()
        if left is not None and found >= left:
            level = level.orderBy("path").limit(left)
        if found:
            out = level if out is None else out.unionByName(level)
        if left is not None:
            left -= min(left, found)
        if not found or left == 0:
            break
    if out is None:
        out = level
    return out.select("root", "node", (F.size("path") - 1).alias("depth"), "path", "is_cycle", (F.size("path") == 2).alias("is_direct"))


# Levels that one written table goes down, once it has gone down a few: a job for each would cost more than its rows.
LEVELS = 8


def _settled(state: DataFrame, step: Callable[[DataFrame], DataFrame], label: str, differs: Callable[[DataFrame, DataFrame], bool]) -> DataFrame:
    """``step`` until nothing changes: 1, 2, 4 and then LEVELS of them for each written table."""
    levels = 1
    while True:
        after = state
        for _ in range(levels):
            after = step(after)
        after = materialize(after, label)
        if not differs(state, after):
            return after
        state, levels = after, min(2 * levels, LEVELS)


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ends = (nodes.select(F.col("node").alias(end)) for end in ("src", "dst"))
    return reduce(lambda rows, end: rows.join(end, end.columns, "left_semi"), ends, edges)


def _fewer(before: DataFrame, after: DataFrame) -> bool:
    return after.count() < before.count()


def _doubled(flow: DataFrame, come: str, go: str, label: str) -> list[DataFrame]:
    """Where the nodes with one way on are after 1, 2, 4 and more steps: (node, at, low, open) for each of these lengths.

    ``low`` is the smallest node passed so far, the one that is reached left out. ``open`` tells whether ``at`` has one way on
    too; the others stay where they are. The last table is the first whose walks end at as many open nodes as those of half
    their length: these are the nodes of closed rings, and every walk that is not closed has come to one.
    """
    single = flow.groupBy(F.col(come).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(go).alias("at")).where("n = 1")
    single = materialize(single.select("node", "at"), f"{label}-single")
    known = single.select(F.col("node").alias("at"), F.lit(True).alias("open"))
    first = single.join(known, "at", "left").select("node", "at", F.col("node").alias("low"), F.coalesce("open", F.lit(False)).alias("open"))
    jumps, ends = [materialize(first, f"{label}-jumps")], None
    while True:
        now = jumps[-1]
        reached = now.where("open").select("at").distinct().count()
        if not reached or reached == ends:
            return jumps
        ends = reached
        jumps.append(materialize(now.where("NOT open").unionByName(_onward(now.where("open"), now)), f"{label}-jumps"))


def _onward(rows: DataFrame, jumps: DataFrame) -> DataFrame:
    """The rows taken as far again as they came."""
    ahead = jumps.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("low").alias("further_low"), F.col("open").alias("further_open"))
    low = F.least("low", "further_low").alias("low")
    return rows.join(ahead, "at").select("node", F.col("further").alias("at"), low, F.col("further_open").alias("open"))


def _rings(jumps: DataFrame, label: str) -> DataFrame:
    """(node, component) of the closed rings that the open walks of the last jumps end in."""
    ring = jumps.join(jumps.where("open").select(F.col("at").alias("node")).distinct(), "node", "left_semi")
    while True:
        ring = materialize(ring, f"{label}-rings")
        after = _onward(ring, ring)
        lower = after.select("node", F.col("low").alias("component")).join(ring, "node").where("component < low")
        if lower.isEmpty():
            return ring.select("node", F.col("low").alias("component"))
        ring = after


Members = Callable[[DataFrame], DataFrame]


def _folded(flow: DataFrame, come: str, go: str, label: str) -> tuple[DataFrame, Members]:
    """The edges without the nodes that have one way on, and what gives these nodes back once the components are known.

    An edge to such a node becomes one to the first node behind it that has several ways on, or none. All walks between the nodes
    that are left stay, so their components do. Steps double, so a chain of n nodes takes log n joins. ``come`` and ``go`` are
    the ends of an edge by the direction of the walk.
    """
    jumps = _doubled(flow, come, go, label)
    last = jumps[-1]
    rings = _rings(last, label) if not last.where("open").isEmpty() else last.where("false").select("node", F.col("low").alias("component"))
    into = materialize(flow.join(last.select(F.col("node").alias(come)), come, "left_anti"), f"{label}-into")
    ends = last.select(F.col("node").alias(go), F.col("at").alias("end"), "open")
    led = into.join(ends, go, "left").where("open IS NOT TRUE").select(come, F.coalesce("end", go).alias(go))
    led = materialize(led.distinct(), f"{label}-edges")

    def members(found: DataFrame) -> DataFrame:
        # a way back to a node itself, all of it through nodes that were taken away
        found = found.unionByName(led.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
        found = materialize(found.groupBy("node").agg(F.min("component").alias("component")), f"{label}-found")
        if found.isEmpty():
            return rings
        begun = into.join(ends.where("NOT open"), go).join(found.select(F.col("node").alias(come), "component"), come)
        begun = begun.join(found.select(F.col("node").alias("end"), "component"), ["end", "component"], "left_semi")
        passed = materialize(begun.select(F.col(go).alias("node"), "component").distinct(), f"{label}-passed")
        for jump in jumps:
            more = passed.join(jump, "node").select(F.col("at").alias("node"), "component")
            passed = materialize(passed.unionByName(more).distinct(), f"{label}-passed")
        every = materialize(found.unionByName(passed).distinct(), f"{label}-found")
        least = every.groupBy("component").agg(F.min("node").alias("least"))
        return every.join(least, "component").select("node", F.col("least").alias("component")).unionByName(rings)

    return led.where("src <> dst"), members


def lineage_cycles(edges: DataFrame, label: str = "cycles") -> DataFrame:
    """The nodes that reach themselves: (node_id, component), the component being the smallest node they share cycles with.

    Nodes that nothing comes to, or that lead nowhere, are taken away, then those with one way on and those with one way in, as
    long as that leaves at most half of the edges: a graph in which each node has one way on is done with that, in joins that
    grow with the logarithm of its longest walk. What is left is coloured (``_coloured``). Each step is an equi join and a
    map-side combined aggregation; only counts of rows come to the driver. Edges without a source or target are passed over.
    """
    edges = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), f"{label}-edges")
    flow, taken = edges.where("src <> dst"), []
    before = flow.count()
    while before:
        ends = flow.select(F.col("dst").alias("node")).distinct(), flow.select(F.col("src").alias("node")).distinct()
        for side, nodes in zip(("src", "dst"), ends, strict=True):
            flow = flow.join(nodes.select(F.col("node").alias(side)), side, "left_semi").select("src", "dst")
        flow = materialize(flow, f"{label}-edges")
        for come, go in (("src", "dst"), ("dst", "src")):
            if not flow.isEmpty():
                flow, members = _folded(flow, come, go, label)
                taken.append(members)
        after = flow.count()
        if 2 * after > before:
            break
        before = after
    found = flow.where("false").select(F.col("src").alias("node"), F.col("src").alias("component"))
    if before:
        found = _coloured(flow, label)
    for members in reversed(taken):
        found = members(found)
    out = found.unionByName(edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
    # a node with an edge to itself may be in a larger component too; that one's smallest node is not above it
    return out.groupBy(F.col("node").alias("node_id")).agg(F.min("component").alias("component"))


def _coloured(flow: DataFrame, label: str) -> DataFrame:
    """(node, component) of the components of ``flow``, which has no edge from a node to itself.

    Nodes that no long walk comes to, or leaves, are taken away first; without cycles nothing is left. The others take the
    smallest node that reaches them as their colour. The nodes of a colour that reach its own node are one component; what
    is left of each colour goes round again, as often as cycles follow each other.
    """
    out = flow.where("false").select(F.col("src").alias("node"), F.col("src").alias("component"))
    while True:
        for come, go in (("src", "dst"), ("dst", "src")):
            nodes = materialize(flow.select(F.col(go).alias("node")).distinct(), f"{label}-walked")
            hops = flow.select(F.col(come).alias("node"), F.col(go).alias("next"))
            walked = lambda rows, hops=hops: rows.join(hops, "node").select(F.col("next").alias("node")).distinct()
            flow = materialize(_within(flow, _settled(nodes, walked, f"{label}-walked", _fewer)), f"{label}-edges")
        if flow.isEmpty():
            break
        # an edge from each node to itself lets a step keep what a node has
        ends = flow.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        stay = ends.select(F.col("node").alias("src"), F.col("node").alias("dst"))
        hops = materialize(flow.select("src", "dst").unionByName(stay), f"{label}-hops")
        colour = materialize(ends.select("node", F.col("node").alias("colour")), f"{label}-colours")

        def smallest(rows: DataFrame, hops: DataFrame = hops) -> DataFrame:
            return rows.join(hops, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("colour"))

        def recoloured(before: DataFrame, after: DataFrame) -> bool:
            return not after.join(before, ["node", "colour"], "left_anti").isEmpty()

        colour = _settled(colour, smallest, f"{label}-colours", recoloured)
        sides = (colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst"))
        same = reduce(lambda rows, side: rows.join(side, side.columns[0]), sides, hops).where("src_colour = dst_colour")
        inner = materialize(same.select("src", "dst", F.col("src_colour").alias("colour")), f"{label}-inner")
        own = materialize(colour.where("node = colour"), f"{label}-members")

        def reaching(rows: DataFrame, inner: DataFrame = inner) -> DataFrame:
            back = inner.select("src", F.col("dst").alias("node"))
            return rows.join(back, "node").select(F.col("src").alias("node"), "colour").distinct()

        members = _settled(own, reaching, f"{label}-members", lambda before, after: _fewer(after, before))
        shared = members.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
        held = members.join(shared, "colour", "left_semi")
        out = out.unionByName(held.select("node", F.col("colour").alias("component")))
        rest = colour.join(members.select("node"), "node", "left_anti")
        flow = materialize(_within(inner.where("src <> dst").select("src", "dst"), rest), f"{label}-edges")
    return out


WAYS = T.DecimalType(38, 0)


def _total(ways: Column) -> Column:
    """The exact sum, NULL from 10^38."""
    return F.when(F.count(F.lit(1)) == F.count(ways), F.try_sum(ways))


def impact_counts(edges: DataFrame, roots: DataFrame, label: str = "impact-counts") -> DataFrame:
    """How many paths lead from each root to each node it reaches, and the shortest and longest, without listing paths.

    Cycles are found first and count as one node each, whose nodes all have its figures and ``in_cycle``; ``paths`` is then
    exact: the number of ways into a node, or into its cycle (1 of length 0 for the root's own). NULL from 10^38. Paths of
    equal length between the same nodes are one row with their number, so the work is that of (root, node, length), not of
    the paths. Nodes that lead nowhere are left out of the search for cycles and of the walk; one join gives them the ways into
    the nodes before them. Returns root, node, paths, shortest, longest, in_cycle.
    """
    flow = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), f"{label}-edges")
    leads = F.max(F.col("src") != F.col("dst")).alias("leads")
    marks = materialize(flow.groupBy(F.col("src").alias("node")).agg(leads, F.max(F.col("src") == F.col("dst")).alias("looped")), f"{label}-marks")
    marked = flow.where("src <> dst").join(marks.withColumnRenamed("node", "dst"), "dst", "left")
    marked = materialize(marked.select("src", "dst", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("leads", "looped")]), f"{label}-edges")
    inner = marked.where("leads").select("src", "dst")

    begin = roots.select(F.col("node_id").alias("node")).where("node IS NOT NULL").distinct()
    own = marks.where("looped AND leads").unionByName(marks.where("looped AND NOT leads").join(begin, "node", "left_semi").select(*marks.columns))
    own = own.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    cycles = materialize(lineage_cycles(inner.unionByName(own), label), f"{label}-components")

    def joined(rows: DataFrame, column: str) -> DataFrame:
        of = cycles.where("node_id <> component").select(F.col("node_id").alias(column), "component")
        return rows.join(of, column, "left").withColumn(column, F.coalesce("component", column)).drop("component")

    ways = joined(joined(inner, "src"), "dst").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast(WAYS).alias("ways"))
    ways = materialize(ways, f"{label}-ways")

    def onward(rows: DataFrame) -> DataFrame:
        reached = rows.join(ways, F.col("node") == F.col("src"))
        by = ["root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")]
        more = reached.select(*by, F.try_multiply("paths", "ways").cast(WAYS).alias("paths"))
        return more.groupBy("root", "node", "depth").agg(_total(F.col("paths")).alias("paths"))

    begin = joined(begin.select(F.col("node").alias("root"), "node"), "node")
    front = materialize(begin.select("root", "node", F.lit(0).alias("depth"), F.lit(1).cast(WAYS).alias("paths")), label)
    depth, levels, out = 0, 1, front
    while True:
        walks = front
        for _ in range(levels):
            walks = front.unionByName(onward(walks))
        walks = materialize(walks.where(F.col("depth") > depth), label)
        out, depth, levels = out.unionByName(walks), depth + levels, min(2 * levels, LEVELS)
        front = walks.where(F.col("depth") == depth)
        if front.isEmpty():
            break
    found = out.groupBy("root", "node").agg(_total(F.col("paths")).alias("paths"), F.min("depth").alias("shortest"), F.max("depth").alias("longest"))
    found = materialize(found, f"{label}-found")
    last = joined(marked.where("NOT leads").drop("leads"), "src")
    ends = found.withColumnRenamed("node", "src").join(last, "src").groupBy("root", F.col("dst").alias("node"))
    lengths = (F.min("shortest") + 1).alias("shortest"), (F.max("longest") + 1).alias("longest")
    ends = ends.agg(_total(F.col("paths")).alias("paths"), *lengths, F.max("looped").alias("in_cycle"))
    members = cycles.select(F.col("component").alias("node"), F.col("node_id").alias("member"))
    found = found.join(members, "node", "left")
    rows = found.select(
        "root", F.coalesce("member", "node").alias("node"), "paths", "shortest", "longest", F.col("member").isNotNull().alias("in_cycle")
    )
    return rows.where("in_cycle OR longest > 0").unionByName(ends)


def stale_models(models: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Models (node_id, status) that read a failed source (``source``) directly become stale.

    ``edges``: src, dst, source. A model in error stays in error.
    """
    hit = edges.join(failed.select("source").distinct(), "source", "left_semi").select(F.col("dst").alias("node_id")).distinct()
    joined = models.join(hit.withColumn("_hit", F.lit(True)), "node_id", "left")
    stale = F.col("_hit").isNotNull() & ~F.col("status").eqNullSafe(F.lit("error"))
    return joined.select("node_id", F.when(stale, "stale").otherwise(F.col("status")).alias("status"))


# --- freshness --------------------------------------------------------------------------


def latest_load(history: DataFrame) -> DataFrame:
    """The newest load of each source, as one aggregation."""
    best = F.max_by(F.struct(F.col("timestamp").alias("last_sync_time"), F.col("status").alias("last_sync_status")), F.struct("timestamp", "status"))
    return history.groupBy("source").agg(best.alias("_b")).select("source", "_b.*")


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / HOUR


def freshness(sources: DataFrame, history: DataFrame, now: datetime | Column) -> DataFrame:
    """never_synced, failed or synced per source, with the hours since; a partial load counts as synced."""
    joined = sources.select("source").join(latest_load(history), "source", "left").withColumn("_now", moment(now))
    good = F.col("last_sync_status").isin("success", "partial")
    status = F.when(F.col("last_sync_status").isNull(), "never_synced").when(good, "synced").otherwise("failed")
    hours = F.round(hours_between(F.col("_now"), F.col("last_sync_time")), 1)
    return joined.select(
        "source", status.alias("status"), F.when(good, hours).alias("hours_since_sync"), "last_sync_time", "last_sync_status"
    )


def staleness(history: DataFrame, now: datetime | Column) -> DataFrame:
    """Sources whose last load is older than twice the shortest interval between two of their loads.

    Gaps are taken within (source, hour) groups, so one busy source is not one task.
    """
    loads = history.select("source", "timestamp").distinct()
    gaps = previous_time(loads, ["source"], "timestamp", "_before").withColumn(
        "_gap", hours_between(F.col("timestamp"), F.col("_before"))
    )
    rows = gaps.groupBy("source").agg(F.min("_gap").alias("_gap"), F.max("timestamp").alias("last_load"))
    interval = F.coalesce("_gap", F.lit(float(FALLBACK_HOURS)))
    since = hours_between(F.col("_now"), F.col("last_load"))
    return rows.withColumn("_now", moment(now)).select(
        "source", "last_load", interval.alias("interval_hours"), since.alias("hours_since_load"), (since > STALE_INTERVALS * interval).alias("is_stale")
    )


def quality_summary(sources: DataFrame, events: DataFrame, findings: DataFrame) -> DataFrame:
    """Drift events, personal-data findings and the columns that have them, per source."""
    drift = events.groupBy("source").agg(F.count(F.lit(1)).alias("drift_event_count"))
    columns = findings.groupBy("source", "table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    pii = columns.groupBy("source").agg(F.sum("n").alias("pii_finding_count"), F.count(F.lit(1)).alias("pii_column_count"))
    out = sources.select("source").distinct().join(drift, "source", "left").join(pii, "source", "left")
    return out.na.fill(0, ["drift_event_count", "pii_finding_count", "pii_column_count"])


# --- logs -------------------------------------------------------------------------------

LOG_SCHEMA = "timestamp string, level string, category string, event string, user_id string, message string"
DEFAULT_CATEGORY = "core"


def read_log(spark: SparkSession, path: str, schema: str | T.StructType = LOG_SCHEMA) -> DataFrame:
    """JSON lines as a table; lines that are not JSON are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # try_parse_json tells a broken line from an object without the wanted keys.
    whole = lines.where(F.try_parse_json("value").isNotNull())
    rows = whole.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).where("r IS NOT NULL").select("r.*")
    return rows.withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))


def log_query(
    log: DataFrame, category: str | None = None, since: str | None = None, event: str | None = None, user: str | None = None, *, limit: int
) -> DataFrame:
    """The newest entries that match, at most ``limit`` (the report's own limit)."""
    rows = log
    for column, value in (("category", category), ("event", event), ("user_id", user)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= since)
    rest = [F.col(c) for c in log.columns if c != "timestamp"]
    return rows.orderBy(F.desc("timestamp"), *rest).limit(limit)
