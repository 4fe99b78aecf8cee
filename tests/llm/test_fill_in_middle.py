from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import fill_in_middle as fim
from millrace.llm import queries
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def brute_boundaries(text):
    ends = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    return [0, *ends]


@given(st.text(alphabet=st.one_of(st.sampled_from("aZ \n<>ſK@[`{"), st.characters(exclude_categories=("Cs",)))))
def test_boundaries(text):
    assert fim.boundaries(text).tolist() == brute_boundaries(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9), st.integers(1, 5000)), max_size=400), st.sampled_from([1, 3, 126]))
def test_lines_stay_within_their_error(steps, error):
    places = np.r_[0, np.cumsum(steps, dtype=np.int64)]
    ranks, slopes = fim.fit(places, error, window=16)
    off = places - fim.predict(places[ranks], ranks, slopes, len(places))
    assert abs(off).max() <= error + 1
    assert ranks[0] == 0 and (np.diff(ranks) > 0).all()


def test_few_segments_for_plain_text():
    text = "some words of several lengths, one behind the other. " * 20_000
    ranks, _ = fim.fit(fim.boundaries(text))
    assert len(ranks) == 1


def test_any_rank_is_found(spark, documents):
    text = "".join("ab " * (k % 3) + "x" * (k * 37 % 900) + "é, " for k in range(200))
    want = brute_boundaries(text)
    indexed = fim.rank_index(documents([(1, text)]))
    at = indexed.select("__index", F.explode(F.sequence(F.lit(0), F.lit(len(want) - 1))).alias("rank"))
    got = at.select("rank", fim.place(F.col("__index"), F.col("rank")).alias("place"), F.size("__index.ranks").alias("segments")).orderBy("rank").collect()
    assert [r.place for r in got] == want
    assert got[0].segments > 1


def expected(doc_id, text, seed=1):
    text = text or ""
    places = brute_boundaries(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(places) - 1
    a, b = (places[x] for x in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_registered_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        *want, output = expected(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("text", ["<", "a<", "<S", "S>x", "<<P", "M><", "P>S>M>", "𝔘x é\n", "a\x00b"])
def test_texts_that_look_like_markers(documents, text):
    rows = fim.fill_in_middle(documents([(k, text) for k in range(60)])).collect()
    whole = hashlib.sha256(text.encode()).hexdigest()
    assert all(r.restored_sha256 == whole for r in rows)
    assert len({r.form for r in rows}) == 3


def test_marker_keeps_a_text_plain(documents):
    rows = fim.fill_in_middle(documents([(k, f"text with {m} in it") for k, m in enumerate(["<P>", "<S>", "<M>"] * 5)])).collect()
    assert {r.form for r in rows} == {"plain"} and {r.prefix_chars for r in rows} == {None}


def test_other_seed_from_the_same_index(documents):
    docs = [(k, f"one two three four {k}") for k in range(40)]
    indexed = fim.rank_index(documents(docs))
    for seed in (1, 2):
        rows = {r.doc_id: r["__output"] for r in fim.transform(indexed, seed).select("doc_id", "__output").collect()}
        assert rows == {k: expected(k, t, seed)[-1] for k, t in docs}


def test_odd_input(odd):
    full, empty = odd
    rows = fim.fill_in_middle(full).collect()
    assert len(rows) == full.count()
    want = sorted((str(d.doc_id), *map(str, expected(d.doc_id, d.text)[:-1])) for d in full.collect())
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars)) for r in rows) == want
    assert fim.fill_in_middle(empty).count() == 0
    assert set(full.columns) < set(fim.rank_index(full).columns)
