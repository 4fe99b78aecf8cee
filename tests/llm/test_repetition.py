from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import queries, repetition
from millrace.llm.repetition import Limits

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    words = (text or "").encode("utf-8", "replace").split()
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    windows = [tuple(words[i : i + 5]) for i in range(max(0, n - 4))]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    return n, len(covered), max(longest, default=0)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), max_size=4))
def test_brute_force(texts):
    found = repetition._measure(texts, 5)
    got = list(zip(found["n_words"].tolist(), found["n_repeat_words"].tolist(), found["longest_repeat"].tolist(), strict=True))
    assert got == [brute(t) for t in texts]


@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_suffix_array(tokens):
    n = len(tokens)
    order, levels = repetition.suffix_array(np.array(tokens), np.full(n, n))
    assert [tokens[i:] for i in order] == sorted(tokens[i:] for i in range(n))
    lcp = repetition.common_prefixes(order, levels, np.full(n, n))
    for k in range(1, n):
        a, b = tokens[order[k - 1] :], tokens[order[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == same


def test_base_measures(documents):
    text = "one two three four five six\n seven # eight\n\none two three four five six\n \nlast <b>|"
    row = repetition.quality_rules(documents([(1, text)])).first()
    assert (row.n_words, row.n_dup_lines, row.n_symbols, row.n_repeat_words, row.longest_repeat) == (17, 1, 4, 12, 6)
    assert row.word_chars == sum(map(len, text.split()))
    assert row.base_failed and not row.kept


def test_long_repeat_goes_though_little_is_covered(documents):
    passage = " ".join(f"p{i}" for i in range(50))
    rest = [" ".join(f"{k}w{i}" for i in range(400)) for k in range(3)]
    long, clean = " ".join([rest[0], passage, rest[1], passage, rest[2]]), " ".join(rest)
    rows = {r.doc_id: r for r in repetition.quality_rules(documents([(1, long), (2, clean)])).collect()}
    assert not rows[1].base_failed and rows[1].longest_repeat == 50 and not rows[1].kept
    assert rows[2].kept
    assert repetition.quality_rules(documents([(1, long)]), Limits(max_longest=50)).first().kept


def test_registered_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op4_repetition(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = (d.text or "").encode().split()
        windows = [tuple(words[i : i + 5]) for i in range(max(0, len(words) - 4))]
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 5)}
        r = rows[d.doc_id]
        assert (r.n_words, r.n_repeat_words) == (len(words), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_odd_input(odd):
    full, empty = odd
    rows = repetition.quality_rules(full).collect()
    assert len(rows) == full.count()
    assert all(not r.kept for r in rows if r.n_words < 10)
    assert repetition.quality_rules(empty).count() == 0
    assert repetition.keep_unrepetitive(full).columns == full.columns
    assert repetition.keep_unrepetitive(empty).count() == 0


@pytest.mark.parametrize("text", ["a " * 5000, "a b " * 3000])
def test_periodic_texts(text):
    found = repetition._measure([text], 5)
    n = len(text.split())
    assert found["n_repeat_words"][0] == n and found["longest_repeat"][0] == n - len(set(text.split()))


def test_the_covered_fraction_decides_below_the_base_rule(documents):
    sentence = "this line of nine words is here two times"
    rest = " ".join(f"w{i}" for i in range(100))
    row = repetition.quality_rules(documents([(1, f"{sentence}\n{rest}\n{sentence}"), (2, rest)])).orderBy("doc_id").collect()
    assert not row[0].base_failed and 0.15 < row[0].covered <= 0.2 and not row[0].kept
    assert row[1].kept
