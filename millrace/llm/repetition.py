"""Quality rules: repetition within a document from a suffix array over its words.

The documents of a slice share one suffix array. A word counts as equal only within its own document,
so no common prefix crosses documents. The array is built by prefix doubling, which refines only the
suffixes that are not yet told apart; each doubling leaves ranks by which the longest common prefixes of
neighbours are found from the largest power of two down. The intervals of the LCP array are the repeated
substrings: the longest one that starts at a word is the larger LCP of its two neighbours, and the spans of
all maximal repeats of at least ``min_repeat`` words are the union of those.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pick, shield, slices, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """When a document goes. The first three are the base rules, the last two those of the method.

    The covered fraction is stricter than the base rule: 15 % of words in repeats of five words, the usual bound for prose.
    """

    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    max_covered: float = 0.15
    max_longest: int = 40


def suffix_array(tokens: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all positions, and the ranks by the first 1, 2, 4, ... tokens.

    ``tokens`` must differ between documents; ``end[i]`` is where the document of position i ends.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts  # the rank of a group is the place of its first member
    levels = [rank.astype(np.int32)]
    open_ = ~(first & np.r_[first[1:], True]) if n else first  # places whose group has two members or more
    width = 1
    while open_.any():
        places = np.flatnonzero(open_)
        at = order[places]
        behind = at + width
        next_ = np.where(behind < end[at], rank[np.minimum(behind, n - 1)] + 1, 0)
        resorted = np.lexsort((next_, rank[at]))
        at, next_ = at[resorted], next_[resorted]
        order[places] = at
        old = rank[at]
        first = np.r_[True, (old[1:] != old[:-1]) | (next_[1:] != next_[:-1])]
        starts = places[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        rank = rank.copy()
        rank[at] = starts
        levels.append(rank.astype(np.int32))
        open_ = np.zeros(n, bool)
        open_[places[~(first & np.r_[first[1:], True])]] = True
        width *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """lcp[k]: common tokens of the suffixes at places k - 1 and k; lcp[0] = 0."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    same = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[same - 1], order[same]
    length = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x + (1 << k) <= end[a]) & (y + (1 << k) <= end[b])
        equal = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length += np.where(equal, 1 << k, 0)
    lcp[same] = length
    return lcp


def longest_repeats(tokens: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest repeated substring that starts there."""
    order, levels = suffix_array(tokens, end)
    lcp = common_prefixes(order, levels, end)
    out = np.zeros(len(tokens), np.int64)
    out[order] = np.maximum(lcp, np.r_[lcp[1:], 0][: len(lcp)])
    return out


def covered_words(longest: np.ndarray, min_repeat: int) -> np.ndarray:
    """Whether each word lies in a repeat of ``min_repeat`` words or more."""
    n = len(longest)
    at = np.flatnonzero(longest >= min_repeat)
    steps = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _measure(texts: list[str | None], window: int) -> dict[str, np.ndarray]:
    ids: dict[bytes, int] = defaultdict(count().__next__)
    lists = [words(t) for t in texts]
    n_words = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((ids[w] for x in lists for w in x), np.int64, int(n_words.sum()))
    stops = np.cumsum(n_words)
    doc = np.repeat(np.arange(len(texts)), n_words)
    longest = longest_repeats(flat + doc * max(len(ids), 1), stops[doc])
    covered = covered_words(longest, window)

    def per_doc(values: np.ndarray, how) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        some = n_words > 0
        if some.any():
            out[some] = how.reduceat(values, (stops - n_words)[some])
        return out

    chars, symbols, dup = [], [], []
    for text in texts:
        text = text or ""
        chars.append(len(text) - sum(text.count(c) for c in SPACES))
        symbols.append(sum(text.count(c) for c in SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": per_doc(covered.astype(np.int64), np.add),
        "longest_repeat": per_doc(longest, np.maximum),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")


def measure(docs: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Repetition of every whole ``text``: the ``keep`` columns, the measures and the verdict, a row for each row.

    ``covered`` is the share of words in repeats of ``limits.window`` words or more, ``longest_repeat`` the words
    of the longest repeat. Null, empty and blank texts have no words: all measures are 0 and the base rules reject
    them. Repeated rows are measured each; ids may be null or repeated. An empty table gives an empty one.
    """
    source = pick(docs, *dict.fromkeys([*keep, "text"]))
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    schema = ", ".join([*fields, *[f"`__{m}` bigint" for m in MEASURES]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = _measure(part.column("text").to_pylist(), limits.window)
            columns = [part.column(c) for c in keep] + [pa.array(found[m]) for m in MEASURES]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[f"__{m}" for m in MEASURES]])

    out = source.mapInArrow(run, schema)
    m = {name: F.col(f"__{name}") for name in MEASURES}
    share = F.when(m["n_words"] > 0, m["n_repeat_words"] / m["n_words"]).otherwise(F.lit(0.0))
    failed = (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_window_percent * m["n_words"])
    verdict = (share <= limits.max_covered) & (m["longest_repeat"] <= limits.max_longest)
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        *[m[name].alias(f"__{name}") for name in MEASURES],
        share.alias("__covered"),
        failed.alias("__base_failed"),
        (~failed & verdict).alias("__kept"),
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The measures and the verdict of every document under their plain names, beside its ``doc_id``."""
    out = measure(docs, limits, ("doc_id",))
    return out.select("doc_id", *[F.col(c).alias(c[2:]) for c in out.columns if c.startswith("__")])


def keep_unrepetitive(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    inner, back = shield(docs, "doc_id", "text")
    return measure(inner, limits, tuple(inner.columns)).where("__kept").select(*back)
