"""Drift, personal data, lineage and freshness on small hand-written tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import drift, joins, lineage, pii, timeline
from millrace.session import new_folder

NOW = datetime(2026, 1, 31)
SCHEMA = "source string, table_name string, column_name string, column_type string"


def schema(spark, *rows):
    return spark.createDataFrame([("shop", *r) for r in rows], SCHEMA)


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- drift ------------------------------------------------------------------------------


def test_additive_drift_moves_the_baseline(spark):
    old = schema(spark, ("orders", "id", "int"))
    new = schema(spark, ("orders", "id", "int"), ("orders", "email", "string"), ("fresh", "id", "int"))
    events, baseline, attention = drift.drift_apply(old, new, NOW)
    assert tuples(events, "table_name", "column_name", "event_type", "severity", "detail") == [("orders", "email", "column_added", "additive", "type=string")]
    assert tuples(baseline, "table_name", "column_name") == [("fresh", "id"), ("orders", "email"), ("orders", "id")]
    assert attention.count() == 0


def test_breaking_drift_waits_for_acceptance(spark):
    old = schema(spark, ("orders", "id", "int"), ("orders", "total", "double"), ("gone", "id", "int"))
    new = schema(spark, ("orders", "id", "bigint"), ("orders", "email", "string"))
    events, baseline, attention = drift.drift_apply(old, new, NOW)
    assert tuples(events, "column_name", "event_type", "detail") == [
        ("email", "column_added", "type=string"),
        ("id", "type_changed", "int -> bigint"),
        ("total", "column_removed", "was=double"),
    ]
    assert tuples(baseline, *SCHEMA.replace(" string", "").split(", ")) == tuples(old, *old.columns)
    assert attention.first()["reason"] == "2 breaking schema change(s) detected"
    again, _, _ = drift.drift_apply(baseline, new, NOW)
    assert again.count() == 3
    accepted, cleared = drift.drift_accept(baseline, new, attention, "shop")
    assert cleared.count() == 0
    assert tuples(accepted, "table_name", "column_name", "column_type") == [("gone", "id", "int"), ("orders", "email", "string"), ("orders", "id", "bigint")]
    assert drift.drift_events(accepted, new).count() == 0


def test_keys_of_json(spark):
    rows = ['{"a": 1, "b": "x", "c": [1], "d": {"e": 1}, "f": null, "g": 1.5}', '{"a": "y"}', "not json", "[1]", None]
    df = spark.createDataFrame([(r,) for r in rows], "props string")
    keys = drift.observed_keys(df, "props", F.lit("s"), F.lit("t"))
    out = {r["column_name"]: r["column_type"] for r in drift.keys_as_schema(keys).collect()}
    assert out == {"a": "bigint|string", "b": "string", "c": "array", "d": "object", "f": "void", "g": "double"}


def test_summary_line(spark):
    events = drift.drift_events(schema(spark, ("o", "a", "int"), ("o", "b", "int")), schema(spark, ("o", "a", "string"), ("o", "c", "int")))
    assert drift.drift_summary_line(events).first()["summary"] == "Schema drift detected: 1 column_added, 1 column_removed, 1 type_changed (2 breaking, 1 additive changes)"


def test_observed_schema_skips_bookkeeping(spark):
    df = spark.range(1).withColumn("_load_id", F.lit("x"))
    out = drift.observed_schema(spark, "shop", {"orders": df, "_load_loads": df})
    assert tuples(out, "table_name", "column_name", "column_type") == [("orders", "id", "bigint")]


# --- personal data ----------------------------------------------------------------------

SAMPLES = {
    "mail bob.smith+x@mail.example.co.uk now": ("EMAIL_ADDRESS", 1.0),
    "call +44 20 7946 0958": ("PHONE_NUMBER", 0.7),
    "555-123-4567": ("PHONE_NUMBER", 0.5),
    "pay 4111 1111 1111 1111": ("CREDIT_CARD", 1.0),
    "ssn 123-45-6789.": ("US_SSN", 0.5),
    "host 192.168.0.254": ("IP_ADDRESS", 0.6),
    "2001:0db8:0000:0000:0000:ff00:0042:8329": ("IP_ADDRESS", 0.6),
    "DE89370400440532013000": ("IBAN_CODE", 1.0),
    "pay to DE89 3704 0044 0532 0130 00 now": ("IBAN_CODE", 1.0),
    "GB82 WEST 1234 5698 7654 32": ("IBAN_CODE", 1.0),
    "from fe80::1ff:fe23:4567:890a": ("IP_ADDRESS", 0.6),
    "2001:db8::1 is up": ("IP_ADDRESS", 0.6),
    "at ::1": ("IP_ADDRESS", 0.6),
    "route fe80::/10": ("IP_ADDRESS", 0.6),
    "call 5551234567 today": ("PHONE_NUMBER", 0.5),
}
CLEAN = ["pay 4111 1111 1111 1112", "999.999.999.999", "DE89370400440532013001", "x@y", "order 12", "", "Ünïcode é123", "1234-45-67890", "std::vector", "a :: b", "x::1y", ":::1"]


def test_recognisers(spark):
    df = spark.createDataFrame([("c", v) for v in [*SAMPLES, *CLEAN]], "column_name string, value string")
    out = {(r["value"], r["entity_type"]): r["score"] for r in pii.detect(df).collect()}
    assert out == {(v, e): s for v, (e, s) in SAMPLES.items()}


def test_long_runs_are_searched_in_linear_time(spark):
    # A run of letters that no address ends, beside an @ that makes the recogniser look.
    df = spark.createDataFrame([("c", "a" * 2_000_000 + " @ x@example.com " + "1" * 2_000_000)], "column_name string, value string")
    assert [(r["entity_type"], r["hits"]) for r in pii.detect(df).collect()] == [("EMAIL_ADDRESS", 1)]


def test_iban_against_plain_arithmetic(spark):
    codes = ["GB82WEST12345698765432", "FR1420041010050500013M02606", "GB82WEST12345698765431", "NO9386011117947"]

    def valid(code):
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1

    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r["c"]: r["v"] for r in df.select("c", pii.iban_valid(F.col("c")).alias("v")).collect()} == {c: valid(c) for c in codes}


def customers(spark):
    rows = [(1, "alice@example.com", "555-123-4567", "_"), (2, "bob@example.com", "555-987-6543", "_"), (2, "bob@example.com", None, "_")]
    return spark.createDataFrame(rows, "id int, email string, phone string, _load_id string")


def test_scan_counts_distinct_values(spark):
    out = tuples(pii.pii_scan(customers(spark), "shop", "customers", NOW), "column_name", "entity_type", "sample_count")
    assert out == [("email", "EMAIL_ADDRESS", 2), ("phone", "PHONE_NUMBER", 2)]
    full = tuples(pii.pii_full_scan(customers(spark), "shop", "customers", NOW), "column_name", "entity_type", "sample_count")
    assert full == out


def test_sample_is_bounded_but_the_full_scan_is_not(spark):
    df = spark.range(1000).select(F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"))
    assert pii.pii_scan(df, "s", "t", NOW).first()["sample_count"] == 100
    assert pii.pii_full_scan(df, "s", "t", NOW).first()["sample_count"] == 1000


@pytest.mark.parametrize(("names", "kept"), [(1, False), (3, True)])
def test_person_needs_three_in_ten(spark, names, kept):
    df = spark.createDataFrame([(f"Ann Lee{chr(97 + i)}" if i < names else f"x{i}",) for i in range(10)], "who string")

    def person(text):
        return F.regexp_count(text, F.lit("[A-Z][a-z]+ [A-Z][a-z]+"))

    for scan in (pii.pii_scan, pii.pii_full_scan):
        assert (scan(df, "s", "t", NOW, person=person).where("entity_type = 'PERSON'").count() == 1) is kept


def test_person_is_suppressed_in_structured_text(spark):
    df = spark.createDataFrame([("[" + "Ann Lee " * 20,)], "moves string")

    def person(text):
        return F.regexp_count(text, F.lit("[A-Z][a-z]+ [A-Z][a-z]+"))

    assert pii.pii_scan(df, "s", "t", NOW, person=person).count() == 0


def test_overrides_and_new_findings(spark):
    found = pii.pii_scan(customers(spark), "shop", "customers", NOW)
    reviewed = spark.createDataFrame([("shop", "customers", "phone", "not_pii"), ("shop", "customers", "id", "pii"), ("shop", "customers", "email", "pii")], "source string, table_name string, column_name string, pii_status string")
    out = pii.pii_overrides(found, reviewed, NOW)
    assert tuples(out, "column_name", "entity_type", "confidence", "sample_count") == [("email", "EMAIL_ADDRESS", 1.0, 2), ("id", "MANUAL_OVERRIDE", 1.0, 0)]
    assert tuples(pii.pii_new_findings(out, found), "column_name") == [("id",)]
    stored = pii.store_findings(found, out)
    assert tuples(stored, "column_name") == [("email",), ("id",)]


# --- lineage ----------------------------------------------------------------------------


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def root(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def paths(df):
    return sorted((">".join(r["path"]), r["is_cycle"]) for r in df.collect())


def test_diamond_gives_two_paths(spark):
    out = lineage.impact_tree(edges(spark, "ab", "ac", "bd", "cd"), root(spark, "a"))
    assert paths(out) == [("a>b", False), ("a>b>d", False), ("a>c", False), ("a>c>d", False)]
    assert {r["node"] for r in out.where("is_direct").collect()} == {"b", "c"}


def test_cycles_end_marked(spark):
    assert paths(lineage.impact_tree(edges(spark, "xy", "yx", "yz"), root(spark, "x"))) == [("x>y", False), ("x>y>x", True), ("x>y>z", False)]
    assert lineage.impact_tree(edges(spark, "ab"), root(spark, "b")).count() == 0


def test_long_chain(spark):
    chain = spark.range(12).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    out = lineage.impact_tree(chain, root(spark, "0"))
    assert out.count() == 12 and out.agg(F.max("depth")).first()[0] == 12


def ladder(spark, rungs):
    """A chain of diamonds: n0 to l0 and r0, both to n1, and so on."""
    pairs = []
    for i in range(rungs):
        pairs += [(f"n{i}", f"l{i}"), (f"n{i}", f"r{i}"), (f"l{i}", f"n{i + 1}"), (f"r{i}", f"n{i + 1}")]
    return edges(spark, *pairs)


def test_paths_of_a_ladder_are_counted(spark):
    out = {r["node"]: r for r in lineage.impact_counts(ladder(spark, 40), root(spark, "n0")).collect()}
    assert len(out) == 120 and "n0" not in out
    assert all(out[f"n{i}"]["paths"] == 2**i for i in range(1, 41))
    assert (out["n40"]["shortest"], out["n40"]["longest"], out["n40"]["in_cycle"]) == (80, 80, False)


def test_paths_are_bounded_by_the_caller(spark):
    out = lineage.impact_tree(ladder(spark, 40), root(spark, "n0"), max_paths=9)
    found = [r["path"] for r in out.collect()]
    assert sorted(map(len, found)) == [2, 2, 3, 3, 4, 4, 4, 4, 5]
    assert [p for p in found if len(p) == 5] == [["n0", "l0", "n1", "l1", "n2"]]
    assert lineage.impact_tree(edges(spark, "ab", "bc"), root(spark, "a"), max_paths=5).count() == 2


def by_search(pairs):
    """Components by a search from every node."""
    flow = {}
    for a, b in pairs:
        flow.setdefault(a, set()).add(b)
    reach = {}
    for node in {n for p in pairs for n in p}:
        seen, todo = set(), list(flow.get(node, ()))
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += flow.get(at, ())
        reach[node] = seen
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in reach if n in reach[n])


@pytest.mark.parametrize("seed", range(2))
def test_cycles_are_components(spark, seed):
    pick = random.Random(seed)
    names = "abcdefghijklmnopqrst"
    pairs = [pick.choice(names) + pick.choice(names) for _ in range(24)]
    assert tuples(lineage.lineage_cycles(edges(spark, *pairs)), "node_id", "component") == by_search([tuple(p) for p in pairs])


def test_no_cycles_and_no_edges(spark):
    assert lineage.lineage_cycles(edges(spark, "ab", "bc")).count() == 0
    none = spark.createDataFrame([(None, "a"), ("a", None)], "src string, dst string")
    assert lineage.lineage_cycles(none).count() == 0
    assert lineage.impact_counts(none, root(spark, "a", None)).count() == 0


def test_chains_between_nodes_of_cycles(spark):
    # every edge of a random graph as a chain, some of them drawn between the same two nodes
    pick = random.Random(4)
    pairs = []
    for k in range(14):
        a, b = pick.choice("abcdefg"), pick.choice("abcdefg")
        chain = [a, *(f"{pick.choice('019z')}.{k}.{i}" for i in range(pick.randrange(4))), b]
        pairs += zip(chain[:-1], chain[1:], strict=True)
    pairs += [("in", "a"), ("b", "out"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("tail", "r1")]
    want = by_search(pairs)
    assert len({c for _, c in want}) >= 2
    assert tuples(lineage.lineage_cycles(edges(spark, *pairs)), "node_id", "component") == want


def written(monkeypatch):
    """The label and table of everything that is written from now on."""
    found, write = [], lineage.materialize

    def noted(df, label):
        found.append((label, write(df, label)))
        return found[-1][1]

    monkeypatch.setattr(lineage, "materialize", noted)
    return found


def test_a_long_walk_takes_few_steps(spark, monkeypatch):
    # a walk of 700 nodes that ends in a ring of 500
    tables = written(monkeypatch)
    walk = spark.range(1200).select(F.col("id").alias("src"), F.when(F.col("id") == 1199, 700).otherwise(F.col("id") + 1).alias("dst"))
    assert tuples(lineage.lineage_cycles(walk), "node_id", "component") == [(i, 700) for i in range(700, 1200)]
    assert len(tables) < 40


def test_nodes_that_lead_nowhere_are_not_walked(spark, monkeypatch):
    tables = written(monkeypatch)
    hubs = spark.range(10).select(F.lit("root").alias("src"), F.concat(F.lit("hub"), "id").alias("dst"))
    leaves = spark.range(2000).select(F.concat(F.lit("hub"), F.col("id") % 10).alias("src"), F.concat(F.lit("leaf"), F.col("id") % 1500).alias("dst"))
    flow = hubs.unionByName(leaves).unionByName(edges(spark, ("leaf7", "leaf7"), ("lone", "lone")))
    out = {(r["root"], r["node"]): tuple(r)[2:] for r in lineage.impact_counts(flow, root(spark, "root", "leaf8", "lone")).collect()}
    assert len(out) == 1511 and out["root", "hub3"] == (1, 1, 1, False) and out["lone", "lone"] == (1, 0, 0, True)
    assert out["root", "leaf7"] == (1, 2, 2, True) and out["root", "leaf8"] == (1, 2, 2, False)
    counts = [(label, table.count()) for label, table in tables]
    assert sum(n > 100 for _, n in counts) == 2  # the edges, and the edges with the marks of their targets


def test_paths_into_a_cycle(spark):
    # two ways into the cycle of c and d, which is left by one edge of each
    out = lineage.impact_counts(edges(spark, "ab", "ac", "bd", "cd", "dc", "ce", "de", "dd"), root(spark, "a", "c"))
    rows = {(r["root"], r["node"]): (int(r["paths"]), r["shortest"], r["longest"], r["in_cycle"]) for r in out.collect()}
    assert rows == {
        ("a", "b"): (1, 1, 1, False), ("a", "c"): (2, 1, 2, True), ("a", "d"): (2, 1, 2, True), ("a", "e"): (4, 2, 3, False),
        ("c", "c"): (1, 0, 0, True), ("c", "d"): (1, 0, 0, True), ("c", "e"): (2, 1, 1, False),
    }


def test_paths_beyond_all_numbers(spark):
    # 20 layers of 100 nodes, each layer wholly joined to the next: 100^k paths into layer k + 1
    pair = spark.range(19 * 100 * 100).select((F.col("id") / 10000).cast("int").alias("k"), (F.col("id") / 100 % 100).cast("int").alias("a"), (F.col("id") % 100).alias("b"))
    layers = pair.select(F.concat_ws(".", "k", "a").alias("src"), F.concat_ws(".", F.col("k") + 1, "b").alias("dst"))
    first = spark.range(100).select(F.lit("root").alias("src"), F.concat(F.lit("0."), F.col("id")).alias("dst"))
    out = lineage.impact_counts(layers.unionByName(first), root(spark, "root")).where("node IN ('0.7', '18.7', '19.7')")
    assert tuples(out, "node", "paths", "longest") == [("0.7", 1, 1), ("18.7", 100**18, 19), ("19.7", None, 20)]


def test_model_wins_over_source(spark):
    nodes = spark.createDataFrame([("source.orders", "orders", "source"), ("model.orders", "orders", "model")], "node_id string, name string, kind string")
    assert lineage.resolve_name(nodes, "orders").first()["node_id"] == "model.orders"


def test_stale_models_keep_errors(spark):
    models = spark.createDataFrame([("a", "success"), ("b", "error"), ("c", "success"), ("d", None)], "node_id string, status string")
    flow = spark.createDataFrame([("s.t", "a", "s"), ("s.t", "b", "s"), ("o.t", "c", "o"), ("s.t", "d", "s")], "src string, dst string, source string")
    out = lineage.stale_models(models, flow, spark.createDataFrame([("s",)], "source string"))
    assert tuples(out, "node_id", "status") == [("a", "stale"), ("b", "error"), ("c", "success"), ("d", "stale")]


def loads(spark, *rows):
    return spark.createDataFrame([(s, NOW - timedelta(hours=h), st) for s, h, st in rows], "source string, timestamp timestamp_ntz, status string")


def test_freshness(spark):
    history = loads(spark, ("a", 30, "failed"), ("a", 2.26, "partial"), ("b", 5, "success"), ("b", 1, "failed"))
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert tuples(lineage.freshness(sources, history, NOW), "source", "status", "hours_since_sync") == [("a", "synced", 2.3), ("b", "failed", None), ("c", "never_synced", None)]


def test_staleness(spark):
    history = loads(spark, ("a", 1, "success"), ("a", 2, "success"), ("b", 3, "success"), ("b", 4, "success"), ("c", 40, "success"), ("d", 50, "success"), ("d", 200, "success"))
    assert tuples(lineage.staleness(history, NOW), "source", "is_stale") == [("a", False), ("b", True), ("c", False), ("d", False)]


def test_neighbours_match_a_plain_window(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.lit(NOW) + F.make_dt_interval(mins=(F.col("id") * 7919 % 4000 * 17).cast("int"))).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("v"),
    )
    w = Window.partitionBy("k").orderBy("ts")
    ours = timeline.neighbour(timeline.next_time(df, ["k"], "ts", "n"), ["k"], "ts", {"v": "p"})
    plain = df.withColumn("n", F.lead("ts").over(w)).withColumn("p", F.lag("v").over(w))
    assert ours.exceptAll(plain.select(*ours.columns)).count() == 0 and ours.count() == 4000


def test_log_skips_broken_lines(spark):
    path = new_folder(spark, "log")
    lines = ['{"timestamp": "2026-01-01", "event": "a"}', '{"timestamp": "2026-01-02", "category": "sync", "event": "b"}', '{"broken', "", '{"timestamp": "2026-01-03", "event": "c", "extra": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    log = lineage.read_log(spark, path)
    assert [r["event"] for r in lineage.log_query(log, limit=10).collect()] == ["c", "b", "a"]
    assert [r["event"] for r in lineage.log_query(log, category="core", limit=1).collect()] == ["c"]
    assert [r["event"] for r in lineage.log_query(log, since="2026-01-02", event="b", limit=10).collect()] == ["b"]


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "k string, t int, v string")
    assert tuples(joins.join_inner_latest(df, ["k"], "t"), "v") == [("y",), ("z",)]


def paths_of(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    found = drift.observed_paths(df, "j", F.lit("s"), F.lit("t"), most=1)
    types = {r["column_name"]: r["column_type"] for r in drift.paths_as_schema(found).collect()}
    return types, {(r["column_name"], r["kind"]): r["rows"] for r in found.collect()}


def test_paths_at_any_depth_widen(spark):
    types, rows = paths_of(
        spark,
        '{"a": {"b": {"c": 1, "d": null}}, "l": [1, [true]]}',
        '{"a": {"b": {"c": 3000000000, "d": {}}}, "l": []}',
        '{"a": {"b": {"c": null}}, "l": ["x"], "w": 99999999999999999999}',
        '{"a": 5}',
    )
    assert types == {
        "a": "int|object", "a.b": "object", "a.b.c": "bigint", "a.b.d": "object",
        "l": "array", "l[]": "array|int|string", "l[][]": "boolean", "w": "double",
    }
    assert rows["a.b.c", "int"] == 1 and rows["l", "array"] == 3 and rows["a.b.c", "null"] == 1


def test_paths_of_text_that_is_no_object(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert paths_of(spark, None, "", "word", "[1]", "3", '{"a": 1, "a": 2}', '{"a": NaN}', "{", '{"n": null}')[0] == {"n": "null"}
    assert len(paths_of(spark, deep, '{"b": 1}')[0]) in (1, 3001)


def test_pages_behind_a_cursor_with_ties_and_new_rows(spark):
    def row(i, day):
        return (i, None if day is None else datetime(2024, 1, day), "x" if i % 3 else None)

    schema = "id int, at timestamp_ntz, v string"
    rows = [row(i, None if i % 7 == 0 else 1 + i % 2) for i in range(50)]
    seen, after, size = [], None, 8
    for step in range(20):
        # rows come in between: newer than the first page, and ones that tie with what is still to come
        rows = rows + [row(1000 + step, 20), row(2000 + step, None)]
        page = drift.keyset_page(spark.createDataFrame(rows, schema), "at", size, after).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = page[-1]
        if step > 12:
            size = 100
    assert len(seen) == len(set(seen)) and set(range(50)) <= set(seen)
    assert not {1000 + k for k in range(1, 20)} & set(seen)
    kept = drift.keyset_page(spark.createDataFrame(rows, schema), "at", 3, None, {"v": "x", "id": None}).collect()
    assert [r["id"] for r in kept] == sorted(r["id"] for r in kept) and all(r["v"] == "x" for r in kept)


def test_a_page_prunes_the_scan_by_its_time(spark):
    path = new_folder(spark, "pages")
    spark.range(10).selectExpr("id", "date'2024-01-01' AS at").write.parquet(path)
    rows = spark.read.parquet(path)
    plan = drift.keyset_page(rows, "at", 3, rows.first())._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(at" in plan
