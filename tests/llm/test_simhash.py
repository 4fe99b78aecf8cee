from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import queries, simhash
from millrace.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text, length=3):
    words = [w.lower() for w in (text or "").encode().split()]
    runs = [b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Smallest reachable key of every key, comparing all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_registered_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {k: fingerprint(t) for k, t in docs.items()}
    want = groups(prints)
    rows = queries.op5_simhash(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == want[r.doc_id]


def test_links_find_every_pair_within_the_radius(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.append(base)
        for bits in (1, 2, 3, 3, 4):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    want = groups({p: p for p in prints})
    signed = [(simhash._signed(p),) for p in set(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), 3)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(edges).collect()}
    label = {}
    for p in set(prints):
        label.setdefault(want[p], set()).add(found.get(p, p))
    assert all(len(x) == 1 for x in label.values())
    assert len({next(iter(x)) for x in label.values()}) == len(label)


def test_other_radii(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    near = [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(6)]
    for radius in (0, 1, 2, 4, 5):
        want = groups({i: p for i, p in enumerate(near)}, radius)
        frame = spark.createDataFrame([(simhash._signed(p),) for p in set(near)], "fp bigint")
        found = {r.node % (1 << 64): r.root for r in connected_components(simhash.links(frame, radius)).collect()}
        for i, p in enumerate(near):
            for j, q in enumerate(near):
                assert (want[i] == want[j]) == (found.get(p, p) == found.get(q, q))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (7, 6), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_input(odd):
    full, empty = odd
    rows = simhash.near_duplicates(full).collect()
    assert len(rows) == full.count()
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(blank) == 4 and {r.component_id for r in blank} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    kept = simhash.keep_first(full).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4, 6, 7, 8, 9]
    assert simhash.keep_first(full).columns == full.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_dense_fingerprints_under_one_key():
    import time

    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 21, 60_000).astype(np.int64))[:32_000]
    start = time.time()
    a, b = simhash.meet(np.zeros(len(fps), np.int64), fps, 3)
    assert time.time() - start < 10  # about one second on a machine of its own
    assert len(a) > 30_000


@pytest.mark.parametrize("large", [0, 3, 1000])
def test_large_groups_connect_the_same(large):
    rng = np.random.default_rng(7)
    fps = np.unique(rng.integers(0, 1 << 12, 150) * 0x10101 + rng.integers(0, 4, 150)).astype(np.int64)
    keys = np.sort(rng.integers(0, 3, len(fps)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = np.arange(len(fps))
    while True:
        new = np.array([want[near[i] & (keys == keys[i])].min() for i in range(len(fps))])
        if np.array_equal(new, want):
            break
        want = new
    a, b = simhash.meet(keys, fps, 3, large)
    got = np.arange(len(fps))
    at = {int(f): i for i, f in enumerate(fps)}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = got[at[x]], got[at[y]]
        got[got == max(i, j)] = min(i, j)
    assert np.array_equal(got, want)
