from __future__ import annotations

import zlib

import pytest

from millrace.llm import language, queries

FOLDER = "/root/testdata/sf0.01"

ENGLISH = "the quick brown fox jumps over the lazy dog and then the dog runs after the fox through the woods " * 8
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann läuft der hund dem fuchs durch den wald nach " * 8


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents([(1, ENGLISH, "en", None), (2, GERMAN, "de", None), (3, None, "de", None), (4, "x", None, None)]))


def identified(docs, model, **more):
    return {r["doc_id"]: r for r in language.identify(docs, model, **more).collect()}


def test_small_sample(documents, model):
    assert sorted(model) == ["de", "en"]
    got = identified(documents([(1, "The DOG runs after the fox!"), (2, "Der Hund läuft durch den Wald"), (3, "12 + 3 = 15"), (4, None), (5, "")]), model)
    assert [got[i]["__lang"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(got[i]["__score"] == 0 and got[i]["__rejected"] for i in (3, 4, 5))
    assert got[1]["__score"] > 0.9 and not got[1]["__rejected"]


def test_narrow_margins_are_rejected(documents, model):
    got = identified(documents([(1, "qzxv kwpj")]), model, margin=0.2)
    assert got[1]["__rejected"] and got[1]["__lang"] in model


def test_size_is_the_sum_of_the_blocks(model):
    identifier = language.Identifier(model)
    data = language.letters(ENGLISH * 20)
    parts = [data[i : i + language.BLOCK] for i in range(0, len(data), language.BLOCK)]
    assert len(parts) > 1
    assert identifier.sizes(data) == [sum(x) for x in zip(*(identifier.sizes(p) for p in parts), strict=True)]


def test_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op7_language(spark, FOLDER).collect()
    assert len(rows) == len(langs)
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in tested) / len(tested) > 0.95


def test_odd_input(odd, model):
    full, empty = odd
    for learnt in (model, {}, language.fit(full), language.fit(empty)):
        rows = language.identify(full, learnt).collect()
        assert len(rows) == full.count()
        assert all(r["__lang"] == "und" for r in rows if r["doc_id"] in (1, 2, 3))
        assert language.identify(empty, learnt).count() == 0
    assert language.fit(empty) == {}
