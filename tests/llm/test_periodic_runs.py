from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def brute(found, least=6, times=4):
    """All runs by trying every period at every place."""
    n, out = len(found), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and found[j] == found[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def runs(texts, **options):
    """The operator's core over several documents at once."""
    ids, tokens, stops = {}, [], []
    for d, text in enumerate(texts):
        tokens += [ids.setdefault((d, w), len(ids)) for w in text]
        stops += [len(tokens)] * len(text)
    start, stop, period = periodic_runs.periodic_runs(np.array(tokens, np.int64), np.array(stops, np.int64), **options)
    out, before = [], 0
    for text in texts:
        mine = (start >= before) & (start < before + len(text))
        rows = zip((start - before)[mine].tolist(), (stop - start)[mine].tolist(), period[mine].tolist(), strict=True)
        out.append(sorted((s, n, q) for s, n, q in rows))
        before += len(text)
    return out


repeated = st.tuples(st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=9))
texts = st.lists(st.lists(repeated, max_size=3).map(lambda x: [w for part, n, rest in x for w in part * n + rest]), max_size=3)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_brute_force(found):
    assert runs(found) == [brute(t) for t in found]
    assert runs(found, least=1, times=3) == [brute(t, 1, 3) for t in found]


def test_failed_hash_is_drawn_again(monkeypatch):
    text = list("xyzabcabcabcabcabcabdcabcabcabcabc") + ["q"] * 9
    want = brute(text)
    real = periodic_runs.Hashes

    class Blind(real):
        def __init__(self, tokens, attempt):
            super().__init__(np.zeros_like(tokens) if attempt < 3 else tokens, attempt)

    monkeypatch.setattr(periodic_runs, "Hashes", Blind)
    assert runs([text]) == [want]


@pytest.mark.parametrize("period", [1, 2, 7, 50_000])
def test_a_million_words(period):
    assert runs([[k % period for k in range(1_000_000)]]) == [[(0, 1_000_000, period)]]


def test_collapse_keeps_first_period_and_other_columns(documents):
    text = "start  " + "a b c " * 5 + "end"
    frame = documents([(1, text), (2, "no\nrun  here"), (3, None)])
    out = {r.doc_id: r for r in periodic_runs.collapse(frame).collect()}
    assert out[1].text == "start a b c end" and out[2].text == "no\nrun  here" and out[3].text is None
    assert periodic_runs.collapse(frame).columns == frame.columns
    found = {r.doc_id: r for r in periodic_runs.find_runs(frame).collect()}
    assert [tuple(r) for r in found[1]["__runs"]] == [(1, 15, 3)]


def test_registered_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    n_planted = 0
    for d in docs:
        found = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(found)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            found = [found[i] if i < a else found[a + (i - a) % p] for i in range(n)]
        want = brute(found)
        gone = {k for s, length, q in want for k in range(s + q, s + length)}
        r = rows[d.doc_id]
        n_planted += bool(want)
        assert r.n_runs == len(want)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in want)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        kept = b" ".join(w for k, w in enumerate(found) if k not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
    assert n_planted


def test_strongest_of_ties(documents):
    row = periodic_runs.runs_report(documents([(1, "x a a a a a a y b b b b b b z"), (5, "")])).where("doc_id = 1").first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 1, 6, 1, 6000)


def test_odd_input(odd):
    full, empty = odd
    rows = periodic_runs.runs_report(full).collect()
    assert len(rows) == full.count()
    assert {r.length for r in rows if r.doc_id == 7} == {30_000}
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.runs_sha256 == r.collapsed_sha256 == nothing and r.start is None for r in rows if r.doc_id in (1, 2, 3))
    assert periodic_runs.runs_report(empty).count() == 0
    assert periodic_runs.collapse(full).columns == full.columns and periodic_runs.collapse(empty).count() == 0
