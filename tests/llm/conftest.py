from __future__ import annotations

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) or (id, text, lang, source) rows, with extra columns whose names operators also use."""

    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        if extra:
            for name in ("score", "kept", "fp", "size", "copies", "component_id", "items", "hash", "node", "bucket", "doc"):
                frame = frame.selectExpr("*", f"'x' AS `{name}`")
        return frame

    return make


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a text without id"), (4, "same text twice"), (4, "same text twice"),
    (5, "same text twice"), (None, None), (6, "é" * 5), (7, "word " * 30_000), (8, "x" * 200_000), (9, "a\x00b ퟿"),
]


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and blank texts, repeated rows, very long texts; then the same without rows."""
    frame = documents([(i, t, None if k % 3 else "en", None if k % 2 else "s") for k, (i, t) in enumerate(ODD)])
    return frame, frame.limit(0)
