"""Language identification by compression with one zstandard raw-content dictionary for each language.

A text becomes its lower-case letters with one space between words, is cut into blocks, each block is compressed with every language's dictionary, and the language with the
smallest sum of sizes is chosen. Sizes are code lengths, so the score is the posterior of the chosen language
under equal priors. A choice whose margin over the second is narrow is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import pick, slices

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")

#: Bytes that are compressed at a time, and the compression level.
BLOCK = 4096
LEVEL = 6

Model = dict[str, bytes]


def letters(text: str | None) -> bytes:
    """The words of letters in lower case with one space between them; empty if there are none."""
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def fit(
    docs: DataFrame, sample_docs: int = 100, sample_chars: int = 2000, where: Column | None = None, dict_bytes: int = 128 << 10
) -> Model:
    """One dictionary for each value of ``lang`` in ``docs``, from a bounded sample of its rows.

    The sample are the ``sample_docs`` rows of each language with the lowest hash of ``doc_id``, at most
    ``sample_chars`` characters of each from its middle, at most ``dict_bytes`` in all; these parameters bound what the
    driver holds for a language. The rows are found without their texts. Rows with a null language, id or text are not used, nor rows
    that ``where`` excludes. No usable row gives an empty model.
    """
    rows = docs.where("lang is not null and doc_id is not null")
    if where is not None:
        rows = rows.where(where)
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs)
    ids = [(r[0], r[1]) for r in chosen.select("doc_id", "lang").collect()]
    start = F.greatest(F.lit(1), F.floor((F.length("text") - sample_chars) / 2) + 1).cast("int")
    piece = F.substring(F.col("text"), start, F.lit(sample_chars))
    found = rows.where(F.col("doc_id").isin([i for i, _ in ids])).select("doc_id", "lang", piece.alias("piece"))
    wanted = set(ids)
    pieces: dict[str, dict] = {}
    for doc_id, lang, text in found.collect() if ids else []:
        if text and (doc_id, lang) in wanted:
            pieces.setdefault(lang, {})[doc_id] = text  # a repeated id counts once
    joined = {lang: b" ".join(letters(t) for _, t in sorted(x.items())) for lang, x in sorted(pieces.items())}
    return {lang: content[:dict_bytes] for lang, content in joined.items() if content.strip()}


class Identifier:
    """The compressors of a model; made in each task."""

    def __init__(self, model: Model) -> None:
        self.langs = list(model)
        self.compress = []
        for content in model.values():
            table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(level=LEVEL)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=table, **options).compress)

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(f(b)) for b in blocks) for f in self.compress]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, posterior, and margin: the share of the second size that the first one saves."""
        data = letters(text)
        if not data or not self.langs:
            return UNKNOWN, 0.0, 0.0
        sizes = np.array(self.sizes(data), float)
        best = int(np.argmin(sizes))  # of equal sizes the first language in order
        score = 1.0 / float(np.exp2(np.clip(-8.0 * (sizes - sizes[best]), -1000, 0)).sum())
        others = np.delete(sizes, best)
        margin = float(1 - sizes[best] / others.min()) if len(others) else 1.0
        return self.langs[best], score, margin


def identify(docs: DataFrame, model: Model, margin: float = 0.005, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``__lang``, ``__score``, ``__margin`` and ``__rejected`` for every row.

    A null text, one without a letter, and every text under an empty model are ``und`` with score 0 and rejected. Of
    languages with equal sizes the first in order is chosen, and rejected, as any choice whose margin is below
    ``margin``. Whole texts are compressed. Repeated rows come back repeated.
    """
    source = pick(docs, *dict.fromkeys([*keep, "text"]))
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(model)
        for part in slices(batches, "text"):
            found = [identifier(t) for t in part.column("text").to_pylist()]
            langs, scores, margins = (list(x) for x in zip(*found, strict=True))
            columns = [part.column(c) for c in keep]
            columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__lang", "__score", "__margin"])

    out = source.mapInArrow(run, ", ".join([*fields, "__lang string, __score double, __margin double"]))
    return out.withColumn("__rejected", (F.col("__lang") == UNKNOWN) | (F.col("__margin") < margin))
