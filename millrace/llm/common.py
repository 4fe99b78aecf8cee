"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: what stands between ASCII white space. ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that a task turns into arrays at a time; bounds its memory, not its result.
SLICE_CHARS = 1 << 20


def words(text: str | None) -> list[bytes]:
    """The words of a whole text in UTF-8; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def slices(batches: Iterable[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``chars`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can clash with nothing that an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def shield(df: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with names of our own for all columns but ``own``, and the columns that give the old names back.

    So a stage that passes rows on can add helper columns, whatever the columns of its input are called.
    """
    names = {c: c if c in own else f"kept_{k}" for k, c in enumerate(df.columns)}
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return inner, [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def _lower_table() -> bytes:
    table = bytearray(range(256))
    for byte in range(128):
        char = chr(byte)
        table[byte] = ord(char.lower()) if char.isalnum() else 32
    return bytes(table)


_LOWER = _lower_table()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of an odd number modulo 2 ** 64. Not kept: functions travel with their module's values."""
    table = np.full(n, base, np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64, out=table)


@dataclass
class ByteWords:
    """Runs of letters and digits of texts as byte ranges of one array; ``lengths`` are the words of each text.

    Letters are in lower case (ASCII and Latin-1); all characters beyond ASCII count as letters.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each range; equal bytes have equal hashes wherever they stand."""
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def firsts(self) -> np.ndarray:
        """Whether each word is the first one of its text."""
        out = np.zeros(len(self.start), bool)
        out[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = True
        return out


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes of texts with letters in lower case and all that is no part of a word as a space."""
    data = np.frombuffer(bytearray(raw).translate(_LOWER), np.uint8)
    capital = np.flatnonzero(raw[:-1] == 0xC3) + 1
    after = raw[capital]
    data[capital[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)]] += 32
    return data


def byte_words(texts: pa.Array) -> ByteWords:
    """The words of a column of texts, found without making an object for each. Null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = lowered(raw)
    letter = np.zeros(len(data) + 2, bool)
    np.not_equal(data, 32, out=letter[1:-1])
    at = np.flatnonzero(letter[1:] != letter[:-1])  # first bytes and ends of words in turn
    cut = np.unique(offsets[letter[offsets] & letter[offsets + 1]])  # where a text ends in a word and the next begins with one
    at = np.insert(at, np.repeat(np.searchsorted(at, cut), 2), np.repeat(cut, 2))
    start, end = at[::2].copy(), at[1::2].copy()
    bounds = np.searchsorted(start, offsets)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=sums[1:], dtype=np.uint64)
    sums[1:] *= _powers(_BASE, len(data))
    np.cumsum(sums, out=sums)
    return ByteWords(data, start, end, np.diff(bounds), offsets, sums, _powers(_INVERSE, len(data)))
