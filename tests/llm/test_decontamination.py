from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import decontamination, queries

FOLDER = "/root/testdata/sf0.01"


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_common_subsequence(a, b):
    a, b = [x.encode() for x in a], [x.encode() for x in b]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_nystrom_finds_the_leading_vectors():
    rng = np.random.default_rng(0)
    u, v = np.linalg.qr(rng.normal(size=(200, 6)))[0], np.linalg.qr(rng.normal(size=(80, 6)))[0]
    s = np.array([9, 7, 5, 3, 0.01, 0.001])
    a = u * s @ v.T
    omega = rng.normal(size=(80, 12))
    space = decontamination.nystrom(a.T @ (a @ omega), omega, 4)
    assert np.allclose(np.abs(space.T @ v[:, :4] * s[:4]), np.eye(4), atol=1e-3)


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(3000)]
    common = words[:40]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [prose(n) for n in (12, 20, 35, 60, 30, 30)]
    docs = [(i, " ".join(prose(rng.choice((30, 300, 900))))) for i in range(400)]
    for k, item in enumerate(items):
        for copy in range(5):
            docs.append((1000 + 10 * k + copy, " ".join(prose(37 * copy) + item + prose(50))))
        changed = [w if i % 6 else "zzz" for i, w in enumerate(item)]
        docs.append((2000 + k, " ".join(prose(55) + changed + prose(20)).upper()))
    return [(k, " ".join(x) + ".") for k, x in enumerate(items)], docs


def test_planted_items_and_paraphrases(spark, documents):
    items, docs = corpus()
    benchmark = spark.createDataFrame([(*x, "s") for x in items] + [(None, "no id here", "s"), (9, None, "s"), (10, "...", "s")], "item_id bigint, text string, source string")
    found = decontamination.leaks(documents(docs), benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want = {(1000 + 10 * k + copy, k) for k in range(len(items)) for copy in range(5)}
    assert want <= got
    assert {d for d, _ in got} <= {d for d, _ in want} | {2000 + k for k in range(len(items))}
    assert len([d for d, _ in got if d >= 2000]) >= 4
    kept = decontamination.keep_clean(documents(docs), benchmark)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_registered_query_against_search_of_all_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    joined = lambda t: b" " + b" ".join(decontamination.plain_words(t)) + b" "
    parts = [(r.item_id, joined(r.text)) for r in items]
    want = {(d.doc_id, i) for d in docs for i, p in parts if p in joined(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, FOLDER).collect()}
    assert want and len(want & got) >= 0.95 * len(want) and got == want & got


@pytest.mark.parametrize("rows", [[], [(1, "some words that are nowhere else to be found")]])
def test_odd_input(spark, odd, rows):
    full, empty = odd
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    assert decontamination.leaks(full, benchmark).count() == 0 and decontamination.leaks(empty, benchmark).count() == 0
    kept = decontamination.keep_clean(full, benchmark)
    assert kept.columns == full.columns and kept.count() == full.count()


def test_paraphrases_that_change_the_rarest_words(spark, documents):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(3000)]
    prose = lambda n: [rng.choice(words[:60]) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    docs = [(i, " ".join(prose(300))) for i in range(300)]
    seen = Counter(w for _, text in docs for w in set(text.split()))
    items = [prose(36) for _ in range(20)]
    for k, item in enumerate(items):
        rare = sorted(set(item), key=lambda w: (seen[w], w))[:5]
        docs.append((1000 + k, " ".join(prose(50) + ["zzz" if w in rare else w for w in item] + prose(50))))
    table = [(k, " ".join(x)) for k, x in enumerate(items)]
    found = decontamination.leaks(documents(docs), spark.createDataFrame(table, "item_id bigint, text string")).collect()
    least = decontamination.Settings().common
    want = set()
    for d, text in docs:  # all pairs, the best region of each
        text = decontamination.plain_words(text)
        for k, item in table:
            item = decontamination.plain_words(item)
            best = max(decontamination.common_subsequence(item, text[max(0, i - 36) : i + 76]) for i in range(0, len(text), 20))
            if best >= least * len(item):
                want.add((d, k))
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(1000 + k, k) for k in range(20)} <= want
    assert got <= want and len(got) >= 0.9 * len(want)
    # an answer that the benchmark gives still decides
    given = [(*x, "not there at all") for x in table]
    benchmark = spark.createDataFrame(given, "item_id bigint, text string, answer string")
    assert decontamination.leaks(documents(docs), benchmark).count() == 0


def test_ids_of_items_keep_their_type(spark, documents):
    passage = " ".join(f"special{i} word{i}" for i in range(30))
    docs = documents([(1, "before " + passage + " after"), (2, "other text " * 40)])
    benchmark = spark.createDataFrame([("item-a", passage), ("item-b", "nothing like it at all here")], "item_id string, text string")
    found = decontamination.leaks(docs, benchmark)
    assert found.schema["item_id"].dataType.simpleString() == "string"
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, "item-a")]


def test_blocks_of_the_benchmark_give_what_one_block_gives(spark, documents):
    items, docs = corpus()
    extra = [(100 + k, " ".join(f"only{k}x{i}" for i in range(20))) for k in range(30)]
    table = [*items, *extra, items[0], (6, items[1][1])]
    benchmark = spark.createDataFrame(table, "item_id bigint, text string")
    small = decontamination.Settings(block_items=5)
    assert len(list(decontamination.indices(documents(docs), benchmark, small))) == 8
    rows = lambda s: sorted((r.doc_id, r.item_id, round(r.common, 9)) for r in decontamination.leaks(documents(docs), benchmark, s).collect())
    assert rows(small) == rows(decontamination.Settings()) and len(rows(small)) >= 30
    kept = [
        {r.doc_id for r in decontamination.keep_clean(documents(docs), benchmark, s).select("doc_id").collect()}
        for s in (small, decontamination.Settings())
    ]
    assert kept[0] == kept[1] == {d for d, _ in docs} - {d for d, _, _ in rows(small)}


def test_recall_of_paraphrases_in_a_table_much_larger_than_the_sample(spark, documents):
    docs, table = paraphrased(documents=6000, items=100, copies=3)
    settings = decontamination.Settings(sample_docs=500)
    benchmark = spark.createDataFrame(table, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(docs), benchmark, settings).collect()}
    want = all_pairs(docs, table, settings.common)
    assert len(want) >= 150
    assert got <= want and len(got) >= 0.9 * len(want)


def paraphrased(documents, items, copies, seed=3):
    """Documents of words by Zipf's law, and in some an item whose words are partly replaced, left out or moved."""
    rng = np.random.default_rng(seed)
    words = np.array(["w" + "".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(20_000)])
    odds = 1 / np.arange(1, len(words) + 1)
    prose = lambda n: list(rng.choice(words, n, p=odds / odds.sum()))
    table = [(k, prose(int(rng.integers(25, 60)))) for k in range(items)]
    docs = [(i, " ".join(prose(int(rng.integers(40, 300))))) for i in range(documents)]
    for k, item in table:
        for copy in range(copies):
            changed = [w if rng.random() > 0.12 + 0.08 * copy else prose(1)[0] for w in item]
            changed = [w for w in changed if rng.random() > 0.04]
            at = int(rng.integers(0, len(changed) - 4))
            changed[at : at + 4] = changed[at : at + 4][::-1]
            docs.append((100_000 + 10 * k + copy, " ".join([*prose(int(rng.integers(0, 200))), *changed, *prose(50)])))
    return docs, [(k, " ".join(item)) for k, item in table]


def all_pairs(docs, table, least, half=20):
    """Pairs whose common subsequence is long enough within an item's length of some window."""
    want, cut = set(), [(k, decontamination.plain_words(t)) for k, t in table]
    for d, text in docs:
        text = decontamination.plain_words(text)
        there = set(text)
        for k, item in cut:
            if sum(w in there for w in item) < least * len(item):
                continue  # a common subsequence is made of common words
            n = len(item)
            regions = (text[max(0, i - n) : i + 2 * half + n] for i in range(0, len(text), half))
            if max(decontamination.common_subsequence(item, r) for r in regions) >= least * n:
                want.add((d, k))
    return want


def test_the_map_is_fitted_to_all_documents(spark, monkeypatch):
    rows = 24_000
    text = F.concat_ws(" ", F.lit("common words here"), F.concat(F.lit("own"), F.col("id") % 400))
    docs = spark.range(0, rows, 1, 20).select(F.col("id").alias("doc_id"), text.alias("text"))
    settings = decontamination.Settings()
    frequencies, n, parts = decontamination.document_frequencies(docs)
    assert (n, parts) == (rows, 20)
    idf = decontamination.idf_of(frequencies // 2, n)
    monkeypatch.setattr(decontamination, "nystrom", lambda product, omega, rank: product)
    product = decontamination.latent_space(docs, idf, n, parts, settings)
    passages = np.zeros((400, decontamination.TERMS))
    for k in range(400):
        for term in decontamination.terms_of(pa.array([f"common words here own{k}"]))[0]:
            passages[k, term] += idf[term]
    passages /= np.linalg.norm(passages, axis=1, keepdims=True)
    omega = decontamination.random_matrix(7, settings.rank + settings.beyond)
    want = passages.T @ (passages @ omega) * (rows / 400) * idf[:, None]
    assert np.abs(product - want).max() <= 1e-4 * np.abs(want).max()


def test_a_sketch_is_the_product_of_its_passages(monkeypatch):
    monkeypatch.setattr(decontamination, "PASSAGES", 7)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 41, 30)
    flat = rng.zipf(1.3, int(lengths.sum())) % decontamination.TERMS
    idf = rng.random(decontamination.TERMS).astype(np.float32) + 1
    omega, total = decontamination.random_matrix(7, 5), np.zeros((decontamination.TERMS, 5), np.float32)
    starts = np.cumsum(lengths) - lengths
    monkeypatch.setattr(decontamination, "FREQUENT", 4)
    decontamination._sketch(flat, starts, idf, omega, total)
    rows = np.stack([np.bincount(flat[a : a + k], minlength=decontamination.TERMS) * idf for a, k in zip(starts, lengths, strict=True)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.allclose(total, rows.T @ (rows @ omega), atol=1e-4)


def test_words_of_items_are_counted_faster_than_pair_by_pair():
    rng = np.random.default_rng(4)
    settings, lengths = decontamination.Settings(), np.r_[0, rng.integers(1, 800, 400)]
    flat = rng.integers(0, 500, int(lengths.sum())).astype(np.uint16)
    found = [rng.integers(0, 500, 40) for _ in range(200)]
    pairs = sorted((int(t), k, int(n)) for k, f in enumerate(found) for t, n in zip(*np.unique(f, return_counts=True), strict=True))
    pairs = np.array(pairs, np.int64)
    items = [(k, [b"w"] * 40, [], False) for k in range(200)]
    index = decontamination.Index(np.zeros((0, 0)), items, np.zeros((0, 0)), pairs[:, 0], pairs[:, 1:])
    docs = [set(d.tolist()) for d in np.split(flat, np.cumsum(lengths)[:-1])]
    shares = np.array([[sum(t in d for t in f.tolist()) for f in found] for d in docs])
    assert np.array_equal(decontamination._covered(flat, lengths, index, settings), shares >= 28)
    cells, some = np.repeat(np.arange(401), [len(d) for d in docs]), np.concatenate([sorted(d) for d in docs]).astype(np.int64)
    first, count = np.searchsorted(pairs[:, 0], some), np.bincount(pairs[:, 0], minlength=500)[some]
    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    cells, numbers = np.repeat(cells, count) * 200 + pairs[place, 1], pairs[place, 2]
    there = np.zeros(401 * 200, np.int32)

    def seconds(run):
        times = []
        for _ in range(5):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    one_by_one = seconds(lambda: np.add.at(there, cells, numbers))
    assert seconds(lambda: decontamination._covered(flat, lengths, index, settings)) < one_by_one


@settings(deadline=None)
@given(st.lists(st.text(alphabet="aZ 0.\n\x1c\x85\xa0\xc9\xd7\xe9\xdfŁ中", max_size=12) | st.none(), max_size=6))
def test_plain_words_are_the_words_of_the_column(texts):
    found = decontamination.byte_words(pa.array(texts, pa.string()))
    data = found.data.tobytes()
    ours = [data[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
    each = [decontamination.plain_words(t) for t in texts]
    assert ours == [w for ws in each for w in ws] and found.lengths.tolist() == [len(ws) for ws in each]


def test_row_sums_do_not_depend_on_the_block(monkeypatch):
    rng = np.random.default_rng(6)
    owner = np.sort(rng.zipf(1.5, 400) % 50)
    place, values = rng.integers(0, 30, 400), rng.random(400).astype(np.float32)
    table, want = rng.random((30, 5)).astype(np.float32), np.zeros((60, 5))
    np.add.at(want, owner, table[place] * values[:, None])
    for rows in (1, 7, 4096):
        monkeypatch.setattr(decontamination, "ROWS", rows)
        assert np.allclose(decontamination._products(owner, place, values, table, 60), want, rtol=1e-5)
        assert decontamination._products(owner[:0], place[:0], values[:0], table, 0).shape == (0, 5)


def test_windows_without_enough_words_are_not_verified():
    rng = np.random.default_rng(8)
    options = decontamination.Settings(cosine=-1.0)
    word = np.array([f"w{i}" for i in range(60)])
    items = [(k, [w.encode() for w in rng.choice(word, n)], None) for k, n in enumerate((3, 7, 12, 25, 40))]
    texts = [" ".join(rng.choice(word, n)) for n in (1, 5, 39, 40, 41, 300, 900)]
    texts += [" ".join([*rng.choice(word, 70), *(w.decode() for w in f), *rng.choice(word, 30)]) for _, f, _ in items]
    space = rng.normal(size=(decontamination.TERMS, 8)).astype(np.float32)
    index = decontamination.index_of(items, np.ones(decontamination.TERMS), space, options, None)
    got = {(d, i, s) for d, i, s, _ in decontamination._candidates(pa.array(texts), index, options)}
    want, windows = set(), 0
    for d, text in enumerate(texts):
        text = decontamination.plain_words(text)
        for i, item in enumerate(index.items):
            least = decontamination._least(item, options)
            for s in range(0, max(1, len(text) - options.half), options.half):
                windows += 1
                region = set(text[max(0, s - len(item[1])) : s + 2 * options.half + len(item[1])])
                if sum(w in region for w in item[1]) >= least * len(item[1]) - 1e-9:
                    want.add((d, i, s))
    assert got == want and 5 <= len(want) < windows / 2
