from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, queries
from millrace.llm.packing import Vocabulary

FOLDER = "/root/testdata/sf0.001"


def brute_packs(lengths, size):
    """Document by document: into the shortest pack if it fits there, else into a new one."""
    packs = []
    for length in sorted(lengths, reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is None or sum(shortest) + length > size:
            packs.append([length])
        else:
            shortest.append(length)
    return sorted(tuple(p) for p in packs)


sizes = st.integers(1, 24).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=60)))


@settings(max_examples=300, deadline=None)
@given(sizes)
def test_histogram_packs_as_document_by_document(case):
    size, lengths = case
    packs = packing.shortest_pack_first(np.bincount(lengths, minlength=size + 1), size)
    got = [[n for length, many in p.contents() for n in [length] * many] for p in packs for _ in range(p.count)]
    # packs of one fill may change places, which later lengths do not see
    assert sorted(map(sum, got)) == sorted(map(sum, brute_packs(lengths, size)))
    assert sorted(n for p in got for n in p) == sorted(lengths)
    assert all(sum(p) <= size for p in got)


def layout(histogram, size, least):
    """Pieces of every sequence from a plan."""
    plan = packing.plan(histogram, size, least)
    out = defaultdict(list)
    for length in np.flatnonzero(histogram).tolist():
        rank = np.arange(histogram[length])
        loose = rank >= plan.loose_from[length]
        whole = np.full(int((~loose).sum()), length)
        for s, o in zip(*plan.whole(whole, rank[~loose]), strict=True) if len(whole) else ():
            out[int(s)].append((int(o), length))
        if loose.any():
            row, skip, many, sequence, offset = plan.cut(np.full(int(loose.sum()), length), rank[loose])
            for r in range(int(loose.sum())):
                mine = row == r
                assert skip[mine].tolist() == [0, *np.cumsum(many[mine])[:-1].tolist()] and many[mine].sum() == length
            for s, o, n in zip(sequence.tolist(), offset.tolist(), many.tolist(), strict=True):
                out[s].append((o, n))
    return out


@settings(max_examples=200, deadline=None)
@given(sizes, st.integers(1, 4))
def test_every_token_has_one_place(case, least):
    size, lengths = case
    out = layout(np.bincount(lengths, minlength=size + 1), size, least)
    assert sorted(out) == list(range(len(out)))
    fills = []
    for parts in out.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        fills.append(at)
    assert sum(fills) == sum(lengths)
    # besides gaps below ``least`` and less than one sequence in all, nothing is padded
    assert sum(size - f for f in fills if size - f >= least) < size + sum(f == 0 for f in fills)


def test_hot_length_is_cut_to_fill():
    out = layout(np.bincount([1100] * 5000, minlength=2049), 2048, 16)
    assert len(out) == -(-1100 * 5000 // 2048)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(Vocabulary().tokenizer)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(Vocabulary())


def check(rows, docs, tokenizer, size=2048):
    """All contract columns against the tokenizer itself; ``docs`` are distinct (id, text)."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    pieces, inside = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        inside[r.sequence_id].append((r.offset, r.length))
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length > 0
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(own.tobytes()))
    assert set(pieces) == set(ids)
    for d, parts in pieces.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    padding = 0
    for parts in inside.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / sum(map(len, ids.values()))


def test_registered_query_against_the_tokenizer(spark, tokenizer):
    rows = queries.op13_packing(spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert check(rows, docs, tokenizer) < 0.02


def test_many_of_one_length(documents, tokenizer):
    docs = [(k, "word " * 1100) for k in range(300)] + [(1000 + k, "some text") for k in range(40)]
    rows = packing.packing_report(documents(docs).repartition(7)).collect()
    assert check(rows, docs, tokenizer) < 0.01


def test_special_tokens_and_unusual_texts(documents, tokenizer):
    texts = ["<|endoftext|>", "a<|endoftext|> b", "<|endoftext", "it's  I'LL\n\n x", "　x y ٣٤ ½", "नमस्ते 🙂‍↔️", "a\x00b", "  "]
    docs = list(enumerate(texts))
    check(packing.packing_report(documents(docs)).collect(), docs, tokenizer)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_encoder_equals_the_tokenizer(encoder, text):
    assert encoder.ids(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_sequences_hold_their_ids(documents, tokenizer):
    docs = [(k, "word " * (k * 13 % 90)) for k in range(80)]
    packed = packing.pack(documents(docs), size=64, least=4, ids=True)
    found = {r["__sequence"]: np.frombuffer(r["__ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    assert all(len(x) <= 64 for x in found.values())
    want = sorted(i for d, t in docs for i in [*tokenizer.encode(t).ids, 1])
    assert sorted(i for x in found.values() for i in x) == want


def test_odd_input(odd):
    full, empty = odd
    rows = packing.packing_report(full).collect()
    by_id = defaultdict(int)
    for r in rows:
        by_id[r.doc_id] += r.length
    assert by_id[1] == by_id[2] == 1 and by_id[4] == 2 * by_id[5] > 2
    assert {r.doc_id for r in rows} == {r.doc_id for r in full.collect()}
    assert packing.packing_report(empty).count() == 0
