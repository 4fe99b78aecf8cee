from __future__ import annotations

from collections import defaultdict

import pytest

from millrace.llm import mixture


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Share by weight; cap; share again; as told."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


def rows_of(n, source, words):
    return [(100_000 * ord(source[0]) + i, "w " * (words + i % 7), "en", source) for i in range(n)]


def test_targets_and_words(documents):
    rows = rows_of(400, "big", 50) + rows_of(120, "mid", 30) + rows_of(60, "small", 20) + rows_of(3, "tiny", 10)
    out = mixture.mix(documents(rows)).collect()
    assert len(out) == len(rows)
    size, taken, goal, sources = defaultdict(int), defaultdict(int), {}, {r[0]: r[3] for r in rows}
    for r in out:
        s = sources[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        goal[s] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = targets(size)
    for s in size:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 60  # the words of one document
    again = {(r.doc_id, r.taken) for r in mixture.mix(documents(rows, extra=False)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_preferred_documents_are_taken_more_often(spark, documents):
    rows = rows_of(3000, "a", 10) + rows_of(300, "b", 10) + rows_of(300, "c", 10)
    frame = documents(rows).selectExpr("*", "IF(doc_id % 2 = 0, 20.0, 1.0) AS liked")
    out = mixture.mix(frame, preference="liked").where("doc_id < 9800000").collect()
    even, uneven = (sum(r.copies for r in out if r.doc_id % 2 == k) for k in (0, 1))
    assert even > 2 * uneven > 0
    assert abs(sum(r.taken for r in out) - out[0].target) <= 20


def test_odd_input(odd):
    full, empty = odd
    out = mixture.mix(full)
    assert out.count() == full.count() and mixture.mix(empty).count() == 0
    assert out.where("size = 0 and taken <> 0").count() == 0
    kept = mixture.mixed(full)
    assert kept.where("copies_ <= 0").count() == 0
    assert set(kept.columns) == set(full.columns) | {"copies_", "size_", "source_size", "target", "taken"}
    assert mixture.mixed(empty).count() == 0


def test_sources_without_a_sample_are_not_sorted(spark, documents):
    rows = mixture._rows(documents([(i, "one two three", "en", "only") for i in range(50)]), None)
    levels = rows.select("source", "preference", "size")
    sources = mixture.factors(mixture.source_targets(rows), levels.groupBy("source", "preference").sum("size").toDF(*levels.columns))
    assert mixture._cuts(mixture._ranked(rows, sources, 3.0)).count() == 0
    assert [r.copies for r in mixture.take(rows, mixture.plan(rows, (1, 2, 3), 3.0), 3.0).collect()] == [1] * 50


def test_expected_copies_follow_the_preference_and_meet_the_target(documents):
    # a: 3 levels of preference, of which the highest stops at 3 copies; b and c hold the rest
    rows = rows_of(2000, "a", 10) + rows_of(500, "b", 10) + rows_of(4500, "c", 20)
    frame = documents(rows).selectExpr("*", "CAST(CASE doc_id % 10 WHEN 0 THEN 16 WHEN 1 THEN 4 ELSE 1 END AS DOUBLE) AS liked")
    out = mixture.mix(frame, weights=(5, 2, 3), preference="liked").collect()
    sources = {r[0]: r[3] for r in rows}
    for source in "abc":
        own = [r for r in out if sources[r.doc_id] == source]
        level = {k: [r for r in own if {0: 16, 1: 4}.get(r.doc_id % 10, 1) == k] for k in (16, 4, 1)}
        words = {k: sum(r.size for r in x) for k, x in level.items()}
        low, high = 0.0, 100.0
        for _ in range(100):  # the factor at which the expected words are the target
            factor = (low + high) / 2
            low, high = (factor, high) if sum(min(3, factor * k) * w for k, w in words.items()) < own[0].target else (low, factor)
        for k, x in level.items():
            want = min(3.0, factor * k)
            assert {r.copies for r in x} <= {int(want), int(want) + 1, 3 if want > 2.999 else int(want)}
            assert abs(sum(r.copies for r in x) / len(x) - want) < 0.12
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30
    assert {r.copies for r in out if sources[r.doc_id] == "a" and r.doc_id % 10 == 0} == {3}


def test_preferences_that_are_no_numbers_count_as_one(documents):
    frame = documents(rows_of(60, "a", 10) + rows_of(60, "b", 10))
    plain = {(r.doc_id, r.copies) for r in mixture.mix(frame).collect()}
    for value in ("CAST(NULL AS DOUBLE)", "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)", "-1.0", "0"):
        out = mixture.mix(frame.selectExpr("*", f"{value} AS liked"), preference="liked")
        assert {(r.doc_id, r.copies) for r in out.collect()} == plain
