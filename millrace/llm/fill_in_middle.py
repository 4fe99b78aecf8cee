"""Fill-in-middle: texts cut between tokens, at places that a learned rank index of the boundaries gives.

``rank_index`` learns, for every text, where its n + 1 token boundaries are: a line through the boundaries of a stretch
of ranks, as long as none of them is more than ``ERROR`` code points off (a shrinking cone of slopes holds all lines that
do), then the next line. What the line misses is stored as one byte a boundary. To cut at a rank, Spark picks the
segment, predicts the place and adds the residual: exact, without reading the text or a list of offsets. The index
serves any number of cuts, for example with another ``seed`` for each epoch.

A token is a run of ASCII letters or any other single code point.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pick, slices

#: Code points that a line may be off; with rounding, residuals fit a byte.
ERROR = 126
BIAS = 128

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

INDEX = "struct<n:bigint,ranks:array<int>,offsets:array<int>,slopes:array<double>,residuals:binary>"


def boundaries(text: str) -> np.ndarray:
    """The code points before each token, and their number: n + 1 places, one for an empty text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    inside = letter[1:] & letter[:-1]
    return np.r_[0, np.flatnonzero(~inside) + 1, len(points)] if len(points) else np.zeros(1, np.int64)


def fit(places: np.ndarray, error: int = ERROR, window: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """First ranks and slopes of lines that are at most ``error`` off any place."""
    n = len(places)
    ranks, slopes = [], []
    first = 0
    while first < n:
        low, high, at = 0.0, np.inf, first + 1
        while at < n:
            off = places[at : at + window] - places[first]
            run = np.arange(at - first, at - first + len(off))
            lows = np.maximum(np.maximum.accumulate((off - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((off + error) / run), high)
            good = int(np.argmin(lows <= highs)) if lows[-1] > highs[-1] else len(off)
            if good:
                low, high = float(lows[good - 1]), float(highs[good - 1])
            at += good
            if good < len(off):
                break
        ranks.append(first)
        slopes.append((low + high) / 2 if at > first + 1 else 0.0)
        first = at
    return np.array(ranks, np.int64), np.array(slopes)


def predict(places_at: np.ndarray, ranks: np.ndarray, slopes: np.ndarray, n: int) -> np.ndarray:
    """What the lines say for ranks 0 to n - 1; ``places_at`` are the places of the first ranks."""
    lengths = np.diff(np.append(ranks, n))
    run = np.arange(n) - np.repeat(ranks, lengths)
    return np.repeat(places_at, lengths) + np.floor(np.repeat(slopes, lengths) * run + 0.5).astype(np.int64)


def _index(text: str | None) -> dict:
    places = boundaries(text or "")
    ranks, slopes = fit(places)
    rest = places - predict(places[ranks], ranks, slopes, len(places)) + BIAS
    if rest.min() < 0 or rest.max() > 255:
        raise ArithmeticError("a residual does not fit a byte")
    return {
        "n": len(places) - 1,
        "ranks": ranks,
        "offsets": places[ranks],
        "slopes": slopes,
        "residuals": rest.astype(np.uint8).tobytes(),
    }


def rank_index(docs: DataFrame) -> DataFrame:
    """``docs`` and their ``__index`` column, the learned index of every whole ``text``; of an empty one for null.

    Repeated rows and rows without id have one each, an empty table gives an empty one.
    """
    source = pick(docs, *docs.columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct(
            [
                ("n", pa.int64()),
                ("ranks", pa.list_(pa.int32())),
                ("offsets", pa.list_(pa.int32())),
                ("slopes", pa.list_(pa.float64())),
                ("residuals", pa.binary()),
            ]
        )
        for part in slices(batches, "text"):
            found = pa.array([_index(t) for t in part.column("text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "__index"])

    return source.mapInArrow(run, ", ".join([*fields, f"`__index` {INDEX}"]))


def place(index: Column, rank: Column) -> Column:
    """Code points before the token of a rank: the segment's line, then the exact correction."""
    segment = F.size(F.filter(index["ranks"], lambda r: r <= rank)).cast("int")
    run = rank - F.element_at(index["ranks"], segment)
    line = F.element_at(index["offsets"], segment) + F.floor(F.element_at(index["slopes"], segment) * run + F.lit(0.5))
    byte = F.hex(index["residuals"].substr((rank + 1).cast("int"), F.lit(1)))
    return line + F.conv(byte, 16, 10).cast("bigint") - BIAS


def transform(indexed: DataFrame, seed: int, id_column: str = "doc_id") -> DataFrame:
    """``indexed`` (from ``rank_index``) with ``__form``, ``__prefix``, ``__middle``, ``__suffix`` and ``__output``.

    The cuts and the form follow from ``seed`` and the id alone; a null id counts as the empty text. Texts that are
    empty or hold one of the markers stay plain.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    ends = [draw % (F.col("__index.n") + 1) for draw in draws[:2]]
    plain = (text == "") | (draws[2] % 100 >= PLAIN_FROM)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains(text, F.lit(marker))
    form = F.when(plain, "plain").otherwise(F.when(draws[3] % 100 < SPM_BELOW, "spm").otherwise("psm"))
    cut = indexed.withColumn("__form", form)
    cut = cut.withColumn("__first", place(F.col("__index"), F.least(*ends)).cast("int"))
    cut = cut.withColumn("__second", place(F.col("__index"), F.greatest(*ends)).cast("int"))
    parts = {
        "__prefix": text.substr(F.lit(1), F.col("__first")),
        "__middle": text.substr(F.col("__first") + 1, F.col("__second") - F.col("__first")),
        "__suffix": text.substr(F.col("__second") + 1, F.char_length(text)),
    }
    for name, part in parts.items():
        cut = cut.withColumn(name, F.when(F.col("__form") != "plain", part))
    psm = F.concat(F.lit(PREFIX), "__prefix", F.lit(SUFFIX), "__suffix", F.lit(MIDDLE), "__middle")
    spm = F.concat(F.lit(SUFFIX), "__suffix", F.lit(PREFIX), "__prefix", F.lit(MIDDLE), "__middle")
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(text)
    return cut.withColumn("__output", output)


def restore(form: Column, output: Column) -> Column:
    """The text that a form was made of. Markers stand nowhere else in it, so the first of each is the one."""
    everything = F.char_length(output)

    def between(start: Column, marker: str) -> Column:
        return output.substr(start, F.instr(output, F.lit(marker)) - start)

    def behind(marker: str) -> Column:
        return (F.instr(output, F.lit(marker)) + len(marker)).cast("int")

    rest = output.substr(behind(MIDDLE), everything)
    psm = F.concat(between(F.lit(1 + len(PREFIX)), SUFFIX), rest, between(behind(SUFFIX), MIDDLE))
    spm = F.concat(between(behind(PREFIX), MIDDLE), rest, between(F.lit(1 + len(SUFFIX)), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Every document's form, the lengths of its parts and the digests of its output and of the text made from that."""
    out = transform(rank_index(pick(docs, "doc_id", "text")), seed)
    out = out.withColumn("__restored", restore(F.col("__form"), F.col("__output")))
    return out.select(
        "doc_id",
        F.col("__index.n").alias("n"),
        F.col("__form").alias("form"),
        F.char_length("__prefix").cast("bigint").alias("prefix_chars"),
        F.char_length("__middle").cast("bigint").alias("middle_chars"),
        F.sha2("__output", 256).alias("output_sha256"),
        F.sha2("__restored", 256).alias("restored_sha256"),
    )


#: The same from the list of all tokens. A hexadecimal digest group is read digit by digit.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    list_transform([0, 1, 2, 3], lambda g: list_sum(list_transform(range(8), lambda k:
      (instr('0123456789abcdef', substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * g + k::INT, 1)) - 1)
      * (16 ** (7 - k))::BIGINT))::BIGINT) AS h
  FROM documents
), c AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a,
    greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
    array_to_string(tokens[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
