from __future__ import annotations

import numpy as np
import pytest

from millrace.llm import queries, tokens
from millrace.session import new_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary()


def test_registered_query_against_direct_encoding(spark, vocabulary):
    encode = tokens.encoding(vocabulary).encode_ordinary
    want = sorted(len(encode(r.text or "")) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    rows = queries.op8_tokens(spark, FOLDER).collect()
    assert sorted(r.n_tokens for r in rows) == want and all(r.closed for r in rows)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("block", [4, 8, 20, 1 << 20])
def test_documents_across_blocks(spark, tmp_path, wide, block):
    files = {"a.bin": [0, 5, 6, 0, 0, 7, 8, 9, 1, 2, 3, 4, 0], "b.bin": [9, 9, 0, 8], "c.bin": [], "d.bin": [3] * 11}
    for name, ids in files.items():
        np.array(ids, "<u4" if wide else "<u2").tofile(tmp_path / name)
    cut = tokens.blocks(spark, str(tmp_path), block)
    rows = tokens.documents(tokens.separators(cut, wide=wide)).collect()
    got = sorted((r.file[-5], r.document, r.first_token, r.n_tokens, r.closed) for r in rows)
    assert got == [
        ("a", 0, 0, 0, True), ("a", 1, 1, 2, True), ("a", 2, 4, 0, True), ("a", 3, 5, 7, True),
        ("b", 0, 0, 2, True), ("b", 1, 3, 1, False), ("d", 0, 0, 11, False),
    ]


def test_round_trip_over_several_files(spark, documents, vocabulary):
    texts = [f"Some words {i}, " * (i % 9) for i in range(60)]
    folder = new_folder(spark, "tokens")
    tokens.write(documents(list(enumerate(texts))).coalesce(1), folder, vocabulary, file_bytes=300)
    rows = tokens.count_tokens(spark, folder).orderBy("file", "document").collect()
    encode = tokens.encoding(vocabulary).encode_ordinary
    assert [r.n_tokens for r in rows] == [len(encode(t)) for t in texts] and len({r.file for r in rows}) > 3


def test_odd_input(odd, vocabulary):
    full, empty = odd
    rows = tokens.count_text_tokens(full, vocabulary).collect()
    assert len(rows) == full.count() and sum(r.n_tokens == 0 for r in rows) == 3
    assert tokens.count_text_tokens(empty, vocabulary).count() == 0
