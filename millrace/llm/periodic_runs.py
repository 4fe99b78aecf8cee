"""Periodic runs: stretches of words that repeat themselves, found on the diagonals of a text.

Word i matches word i - q on diagonal (lag) q. A diagonal that matches for ``times - 1`` periods on end is a run. To
look at all earlier occurrences of every word is quadratic in a frequent word, so the match lengths grow by blocks:

* Lags from k to 2k - 1 are one class, k a power of two, and a class reads the text in blocks of k words. A run's
  diagonal crosses ``times - 2`` whole blocks at least, so of each block only the rarest word looks up its earlier
  occurrences at the lags of the class. These are the active lags of the block, k at most, so a class is linear in the
  text whatever its words are. Words that occur fewer than ``times`` times start nothing.
* An active lag whose whole block matches adds the block to its match length. At the first block that does not match
  the diagonal ends; its exact ends are found by halving, and it is emitted if it is long enough.
* A lag that is a multiple of the period has the same ends, so of runs with the same ends the shortest period stays.

Blocks are compared by a hash of random base, which never misses a match; each emitted run is then compared word by
word, and a slice in which one fails is done again with another base, so the result is exact.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pick, slices, words

PRIME = (1 << 31) - 1

#: Makes the words of a text from its id and its own words.
Change = Callable[[object, list[bytes]], list[bytes]]


class Hashes:
    """Hashes of all ranges of ``tokens`` modulo a prime; equal ranges have equal hashes."""

    def __init__(self, tokens: np.ndarray, attempt: int) -> None:
        draw = np.random.default_rng(attempt)
        base = int(draw.integers(1 << 20, PRIME))
        n = len(tokens)
        self.powers = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:
            part = self.powers[: min(done, n + 1 - done)]
            self.powers[done : done + len(part)] = part * pow(base, done, PRIME) % PRIME
            done *= 2
        values = draw.integers(1, PRIME, int(tokens.max(initial=0)) + 1)[tokens]
        self.sums = np.zeros(n + 1, np.int64)
        np.cumsum(values * self.powers[:n] % PRIME, out=self.sums[1:])

    def same(self, start: np.ndarray, stop: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether start .. stop equals the words ``lag`` before."""
        here = (self.sums[stop] - self.sums[start]) % PRIME
        before = (self.sums[stop - lag] - self.sums[start - lag]) % PRIME
        return here == before * self.powers[lag] % PRIME


def _active(k: int, order: np.ndarray, keys: np.ndarray, tokens: np.ndarray, often: np.ndarray, stops: np.ndarray, times: int):
    """Block starts and lags from k to 2k - 1 at which the block's rarest word occurred before."""
    n = len(tokens)
    starts = np.arange(n // k) * k
    anchors = often[: len(starts) * k].reshape(-1, k).argmin(axis=1) + starts
    use = (often[anchors] >= times) & (anchors >= k) & (starts + k <= stops[starts])
    starts, anchors = starts[use], anchors[use]
    row = tokens[anchors] * n
    low = np.searchsorted(keys, row + np.maximum(anchors - 2 * k + 1, 0))
    high = np.searchsorted(keys, row + anchors - k, side="right")
    found = np.maximum(high - low, 0)
    at = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
    lags = np.repeat(anchors, found) - order[at]
    blocks = np.repeat(starts, found)
    inside = blocks >= lags
    return blocks[inside], lags[inside]


def _diagonals(k: int, blocks: np.ndarray, lags: np.ndarray, hashes: Hashes, stops: np.ndarray, fewest: int):
    """Start, stop and lag of the stretches whose matched diagonal has ``fewest`` whole blocks or more."""
    match = hashes.same(blocks, blocks + k, lags)
    blocks, lags = blocks[match], lags[match]
    by = np.lexsort((blocks, lags))
    blocks, lags = blocks[by], lags[by]
    begins = np.ones(len(blocks), bool)
    begins[1:] = (lags[1:] != lags[:-1]) | (blocks[1:] != blocks[:-1] + k)
    first = np.flatnonzero(begins)
    length = np.diff(np.append(first, len(blocks)))
    first, length = first[length >= fewest], length[length >= fewest]
    lag, left = lags[first], blocks[first]
    right = left + length * k
    step = k
    while step := step // 2:
        more = (right + step <= stops[left]) & (right + step < len(hashes.sums))
        more[more] = hashes.same(right[more], right[more] + step, lag[more])
        right = right + step * more
        more = left - step >= lag
        more[more] = hashes.same(left[more] - step, left[more], lag[more])
        left = left - step * more
    return left - lag, right, lag


def periodic_runs(tokens: np.ndarray, stops: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and smallest period of all maximal stretches of at least ``least`` words and ``times`` periods.

    ``tokens`` are numbers below their count and differ between documents; ``stops[i]`` is where the document of
    position i ends. Sorted by start, then period.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods need not cross a whole block")
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    keys = tokens[order] * n + order
    often = np.bincount(tokens, minlength=1)[tokens]
    longest = int((stops - np.arange(n)).max(initial=0))
    attempt = 0
    while True:
        attempt += 1
        hashes = Hashes(tokens, attempt)
        parts = []
        k = 1
        while k * times <= longest:
            blocks, lags = _active(k, order, keys, tokens, often, stops, times)
            parts.append(np.stack(_diagonals(k, blocks, lags, hashes, stops, times - 2)))
            k *= 2
        start, stop, lag = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        enough = stop - start >= np.maximum(least, times * lag)
        start, stop, lag = start[enough], stop[enough], lag[enough]
        by = np.lexsort((lag, stop, start))
        start, stop, lag = start[by], stop[by], lag[by]
        own = np.ones(len(start), bool)
        own[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
        start, stop, lag = start[own], stop[own], lag[own]
        if all(np.array_equal(tokens[a + q : b], tokens[a : b - q]) for a, b, q in zip(start, stop, lag, strict=True)):
            by = np.lexsort((lag, start))
            return start[by], stop[by], lag[by]


def _part(lists: list[list[bytes]], least: int, times: int) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each document of a slice."""
    n_words = np.array([len(x) for x in lists], np.int64)
    total, stops = int(n_words.sum()), np.cumsum(n_words)
    tokens = np.empty(total, np.int64)
    done = 0
    for k, found in enumerate(lists):
        ids: dict[bytes, int] = defaultdict(count(done).__next__)
        tokens[stops[k] - n_words[k] : stops[k]] = [ids[w] for w in found]
        done += len(ids)
    start, stop, period = periodic_runs(tokens, np.repeat(stops, n_words), least, times)
    steps = np.bincount(start + period, minlength=total + 1) - np.bincount(stop, minlength=total + 1)
    dropped = np.cumsum(steps[:total]) > 0
    texts = []
    for k, found in enumerate(lists):
        gone = dropped[stops[k] - n_words[k] : stops[k]]
        texts.append(b" ".join([w for w, g in zip(found, gone.tolist(), strict=True) if not g] if gone.any() else found))
    firsts = stops - n_words
    doc = np.searchsorted(stops, start, side="right")
    offsets = np.searchsorted(doc, np.arange(len(lists) + 1))
    fields = [pa.array(x, pa.int64()) for x in (start - firsts[doc], stop - start, period)]
    runs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string())


def find_runs(
    docs: DataFrame, id_column: str = "doc_id", keep: tuple[str, ...] | None = None, least: int = 6, times: int = 4, change: Change | None = None
) -> DataFrame:
    """The ``keep`` columns (the id if not given), ``__runs`` and ``__collapsed`` of every row of ``docs``.

    A run is a stretch of consecutive words with smallest period q, of at least ``least`` words and ``times`` periods,
    that no neighbouring word extends. Its place is counted in words from 0; runs are sorted by start, then period.
    ``__collapsed`` is the text without the words that any run has behind its first period, joined by one space.
    ``change`` may replace the words of a row first. Null, empty and blank texts have no word, no run and an empty
    collapsed text. Repeated rows count each; ids may be null. An empty table gives an empty one.
    """
    keep = (id_column,) if keep is None else keep
    source = pick(docs, *dict.fromkeys([id_column, *keep, "text"]))
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    schema = ", ".join([*fields, "`__runs` array<struct<start:bigint,length:bigint,period:bigint>>", "`__collapsed` string"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lists = [words(t) for t in part.column("text").to_pylist()]
            if change is not None:
                lists = [change(i, w) for i, w in zip(part.column(id_column).to_pylist(), lists, strict=True)]
            columns = [part.column(c) for c in keep] + list(_part(lists, least, times))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__runs", "__collapsed"])

    return source.mapInArrow(run, schema)


def collapse(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """``docs`` with every text that has a run replaced by its collapsed text; the others stay as they are."""
    found = find_runs(docs, docs.columns[0], tuple(docs.columns), least, times)
    text = F.when(F.size("__runs") > 0, F.col("__collapsed")).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first one of ties. Null without runs."""
    better = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, x: F.when(better(best, x), x).otherwise(best))


def planted(doc_id: object, found: list[bytes]) -> list[bytes]:
    """Known runs for one in ten ids: from some word on, the text repeats a part of itself. A null id plants nothing."""
    n = len(found)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + k % p] for k in range(n - a)]


def runs_report(docs: DataFrame) -> DataFrame:
    """The runs of all documents, some of them planted, as counts, the strongest run and digests."""
    found = find_runs(docs, change=planted)
    best = strongest(F.col("__runs"))
    lines = F.transform("__runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("__best", best).select(
        "doc_id",
        F.size("__runs").cast("bigint").alias("n_runs"),
        *[F.col("__best")[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("__best.length") / F.col("__best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("__collapsed", 256).alias("collapsed_sha256"),
    )
