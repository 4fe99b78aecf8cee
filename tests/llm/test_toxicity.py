from __future__ import annotations

import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import queries, toxicity
from millrace.llm.common import byte_words

FOLDER = "/root/testdata/sf0.01"


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    lengths = [5, 1, 3, 0, 4]
    starts = np.zeros(sum(lengths), bool)
    starts[(np.cumsum(lengths) - lengths)[np.array(lengths) > 0]] = True
    scores, trans = rng.normal(size=sum(lengths)), (0.3, -0.7, 1.1)
    f, q = toxicity.forward_backward(scores, starts, trans)
    got, move, at = f * q / (1 + f * q), [[0.0, trans[0]], trans[1:]], 0
    for n in lengths:
        mass, total = np.zeros(n), 0.0
        for labels in product((0, 1), repeat=n):
            w = np.exp(sum(scores[at + i] * y for i, y in enumerate(labels)) + sum(move[a][b] for a, b in zip(labels, labels[1:], strict=False)))
            total += w
            mass += w * np.array(labels)
        assert np.allclose(mass / total, got[at : at + n])
        at += n


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_scan_equals_the_recursion(n):
    rng = np.random.default_rng(n)
    a, b, c, d = rng.uniform(0.1, 2, (4, n))
    r, want = 1.0, []
    for i in range(n):
        r = (a[i] + b[i] * r) / (c[i] + d[i] * r)
        want.append(r)
    assert np.allclose(toxicity.scan(a, b, c, d), want)


def test_byte_words_hash_equal_words_alike():
    texts = pa.array(["Été, un idiot!", None, "idiot un", "", "IDIOT"])
    found = byte_words(texts)
    data = found.data.tobytes()
    words = [data[a:b].decode() for a, b in zip(found.start, found.end, strict=True)]
    assert words == ["été", "un", "idiot", "idiot", "un", "idiot"] and found.lengths.tolist() == [3, 0, 2, 0, 1]
    h = dict(zip(words, found.hashes(found.start, found.end).tolist(), strict=True))
    assert [h[w] for w in words] == found.hashes(found.start, found.end).tolist() and len(set(h.values())) == 3
    part = byte_words(texts.slice(2, 3))
    assert part.lengths.tolist() == [2, 0, 1] and part.hashes(part.start, part.end)[2] == h["idiot"]


def sample(n=300):
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = []
    for i in range(n):
        found = rng.choices(plain, k=60)
        if i % 3 == 0:
            for _ in range(2):
                found.insert(rng.randrange(60), rng.choice(["rotten", "vileness"]))
        rows.append((i, " ".join(found), int(i % 3 == 0)))
    return rows


def test_spans_and_scores(spark, documents):
    rows = sample()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(documents([r[:2] for r in rows]), labels)
    texts = [(1, "abc Rotten! é vileness"), (2, "plain words only"), (3, "é rotten vileness x")]
    got = {r["doc_id"]: r for r in toxicity.tag(documents(texts), model).collect()}
    cut = {i: [t[s.start : s.end] for s in got[i]["__spans"]] for i, t in texts}
    assert cut == {1: ["Rotten", "vileness"], 2: [], 3: ["rotten vileness"]}
    assert got[1]["__score"] > 0.9 and got[3]["__score"] > 0.9 and got[2]["__score"] < 0.2
    assert sorted(r.doc_id for r in toxicity.keep_clean(documents(texts), model).collect()) == [2]


def test_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op1_toxicity(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in tested) / len(tested) > 0.95
    assert not any(a for a, b in tested if b == 0)


def test_no_labels_and_odd_input(spark, odd):
    full, empty = odd
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    for docs in odd:
        model = toxicity.fit(docs, none)
        assert toxicity.tag(full, model).count() == full.count() and toxicity.tag(empty, model).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, toxic int")
    model = toxicity.fit(full, labels)
    rows = toxicity.tag(full, model).collect()
    assert len(rows) == full.count() and all(0 <= r["__score"] <= 1 for r in rows)
    assert len({r["__score"] for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.keep_clean(full, model).columns == full.columns


def test_long_labelled_texts_are_learnt_from(spark, documents):
    def filler(seed):
        return " ".join(f"plain{(i * i + 31 * seed * i + seed) % 997}" for i in range(3000))

    rows = [(i, filler(i) + (" vileword awfulterm " * 3 if i % 2 else " kind words here ") + filler(i + 500)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(rows), labels)
    scores = {r["doc_id"]: r["__score"] for r in toxicity.tag(documents([(100, filler(900) + " vileword awfulterm " * 3), (101, filler(901))]), model).collect()}
    assert scores[100] >= 0.5 > scores[101]
