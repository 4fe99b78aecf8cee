from __future__ import annotations

from pathlib import Path

import pytest

from millrace.llm import licences

MIT = dict(licences.KNOWN[:1])["MIT"]


def found(spark, docs):
    return {r.doc_id: r.licence for r in licences.find_licences(docs, licences.known_digests(spark)).collect()}


@pytest.mark.parametrize(
    "change",
    [
        str,
        str.upper,
        lambda t: t.replace("<year> <copyright holders>", "2019-2021 Some Person <a@b.example>"),
        lambda t: t.replace("Copyright (c) <year> <copyright holders>\n", "(c) 2020 A\n * © B, 2021\nAll rights reserved.\n"),
        lambda t: t.replace("License", "Licence").replace("sublicense", "sub-license"),
        lambda t: " ".join(t.replace("Copyright (c) <year> <copyright holders>\n", "").split()),
        lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */",
        lambda t: t.replace('"Software"', "“Software”").replace(",", " ,"),
    ],
)
def test_forms_of_one_licence(spark, documents, change):
    assert found(spark, documents([(1, change(MIT))])) == {1: "MIT"}


def test_every_known_text_is_found_and_others_are_not(spark, documents):
    rows = [(i, text) for i, (_, text) in enumerate(licences.KNOWN)]
    rows += [(100, MIT + " And more."), (101, MIT[: len(MIT) // 2]), (102, "plain prose")]
    got = found(spark, documents(rows))
    assert got == {i: name for i, (name, _) in enumerate(licences.KNOWN)} | {100: None, 101: None, 102: None}


def test_odd_input(spark, odd):
    full, empty = odd
    rows = licences.find_licences(full, licences.known_digests(spark)).collect()
    assert len(rows) == full.count() and all(r.licence is None for r in rows)
    assert [r.digest for r in rows if r.doc_id == 1] == [None]
    assert licences.find_licences(empty, licences.known_digests(spark)).count() == 0


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0", "Artistic"])
def test_whole_public_texts(spark, documents, name):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no such text on this machine")
    text = path.read_text()
    rows = [(1, text), (2, "Copyright The Authors\n\n" + text), (3, text[: len(text) // 2])]
    got = found(spark, documents(rows))
    assert got[1] and got[1] == got[2] and got[3] is None


def test_lines_of_copyright_in_front(spark, documents):
    named = lambda line: MIT.replace("Copyright (c) <year> <copyright holders>\n", line)
    lines = ["Copyright Jane Doe\n", "Copyright The Authors\nCopyright Jane Doe\n\n", "# Copyright by A, B\n#\n"]
    rows = [(i, named(line)) for i, line in enumerate(lines)] + [(10, MIT + "\n\nCopyright law is more.\n")]
    assert found(spark, documents(rows)) == {0: "MIT", 1: "MIT", 2: "MIT", 10: None}


@pytest.mark.parametrize("line", ["\n", " * \n", "copyright jane doe\n", "Copyright The Authors\n\n", "a title\n"])
def test_hundreds_of_thousands_of_lines_in_front(spark, documents, line):
    body = MIT.replace("Copyright (c) <year> <copyright holders>\n", "")
    rows = [(1, line * 200_000 + "Copyright Jane Doe\n" + MIT), (2, line * 200_000), (3, "MIT License\n" + "copyright x\n" * 200_000 + body)]
    got = found(spark, documents(rows))
    named = line.strip().lower()
    assert got[2] is None
    if not named.startswith("a title"):
        assert got[1] == "MIT"


def test_sql_finds_what_the_query_finds(spark, documents, tmp_path):
    import duckdb

    folder = Path("/usr/share/common-licenses")
    texts = [t for _, t in licences.KNOWN] + [p.read_text() for p in sorted(folder.glob("*")) if p.is_file()]
    rows = [text for t in texts for text in (t, "Copyright The Authors\n\n" + t, "A title\n\nCopyright Jane Doe\ncopyright x\n" + t, t + "\nmore")]
    rows += [None, "", "copyright", "copyright \n", "\ncopyright a\n\n", "Copyright a\nx", "x" * 81 + "\nCopyright a\n" + MIT]
    docs = documents(list(enumerate(rows)), extra=False)
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    theirs = sorted(con.execute(licences.SQL).fetchall())
    ours = sorted(tuple(r) for r in licences.find_licences(docs, licences.known_digests(spark)).select("doc_id", "digest", "licence").collect())
    assert ours == theirs and sum(r[2] is not None for r in ours) > len(licences.KNOWN) * 2
