"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages, overlapping windows of words. Their TF-IDF vectors have one dimension for each hashed
word. A randomised SVD of all passages gives a latent space: tasks multiply their passages A with a random matrix and
then with A again, the partial products of all tasks are added by blocks of terms, and a Nystrom step turns the sum
A'A W into the leading right singular vectors and values. In that space, each dimension scaled to unit variance, passages
are compared with benchmark items by cosine inside the tasks. An inverted index from the terms to the items comes first:
documents that have too few of an item's words, in any order, cannot hold it, and a document without any such item has no
passage compared. Candidates are then verified on their words: the longest common subsequence with the item, near the
passage, must cover most of the item, and most of the item's answer must be there, if the benchmark has one.

The benchmark is the stated query set. It is dealt by hash to blocks of a bounded size, and all documents are searched
for one block after the other, so neither the driver nor a task holds more than one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import byte_words, lowered, pick, shield, slices
from millrace.session import materialize

TERMS = 1 << 16
#: Terms in one block of the sum that tasks add up.
TERM_BLOCK = 1 << 10
#: Pairs of a document's term and an item that are counted at a time, and of a document or window and an item.
PAIRS = 1 << 20
CELLS = 1 << 22
#: Passages that are multiplied at a time, and the terms, most frequent in them, for which that is a dense product.
PASSAGES = 1 << 13
FREQUENT = 512
#: Rows that are summed at a time, so that they stay in a core's cache.
ROWS = 1 << 11


@dataclass(frozen=True)
class Settings:
    """About how many documents the latent space is fitted to (None: all); least number of tasks that sum their passages, where the documents have as many partitions; half a window in words; rank of the latent space and what is computed beyond it; least cosine of a candidate;
    least share of an item's words in common order; least share of its answer; number of the
    rarest words of its ``answer``, or of the item where the benchmark has none, whose share is reported as that of its answer
    (it decides only where the benchmark has an answer); items of fewer words must occur whole; items and bytes of their texts
    in a block, on average over the blocks."""

    sample_docs: int | None = None
    sketches: int = 16
    half: int = 20
    rank: int = 48
    beyond: int = 8
    cosine: float = 0.2
    common: float = 0.7
    answer: float = 0.5
    answer_words: int = 8
    short: int = 8
    block_items: int = 8192
    block_bytes: int = 16 << 20


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed term of every word of a column of texts, and the words of each text."""
    found = byte_words(texts)
    return (found.hashes(found.start, found.end) >> np.uint64(48)).astype(np.uint16), found.lengths


def plain_words(text: str | None) -> list[bytes]:
    """The same words one by one."""
    return lowered(np.frombuffer((text or "").encode(), np.uint8)).tobytes().split()


def _halves(lengths: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every half window, its document, and whether it is followed by one of the same document.

    ``lengths`` are the words of each document; a document without words has no half window.
    """
    counts = -(-lengths // half)
    doc = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(lengths) - lengths)[doc] + place * half
    return starts, doc, place + 1 < counts[doc]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Number of documents with each term, and of documents with a word, over all rows; number of partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(TERMS, np.int64), 0
        for part in slices(batches, "text"):
            terms, lengths = terms_of(part.column("text"))
            order = np.argsort(terms, kind="stable")  # by term, and by document within a term
            term, doc = terms[order], np.repeat(np.arange(len(lengths)), lengths)[order]
            new = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])] if len(term) else np.zeros(0, bool)
            counts += np.bincount(term[new], minlength=TERMS)
            n += int(np.count_nonzero(lengths))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], n])], names=["term", "n"])

    summed = pick(docs, "text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("tasks"))
    out, n, parts = np.zeros(TERMS, np.int64), 0, 1
    for term, count, tasks in summed.collect():  # at most TERMS + 1 rows
        if term < 0:
            n, parts = count, tasks
        else:
            out[term] = count
    return out, n, parts


def idf_of(frequencies: np.ndarray, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1.0 + frequencies)).astype(np.float32)


def _products(owner: np.ndarray, place: np.ndarray, values: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the sum of the rows ``place`` of ``table`` times their values; ``owner`` is in order."""
    counts = np.bincount(owner, minlength=n)
    by = np.argsort(-counts, kind="stable")  # those with most first, so that the j-th of each are a front part
    sizes, first = counts[by], (np.cumsum(counts) - counts)[by]
    out = np.zeros((n, table.shape[1]), np.float32)
    rows = np.empty((min(n, ROWS), table.shape[1]), np.float32)
    for low in range(0, int(np.count_nonzero(counts)), ROWS):
        size, start = sizes[low : low + ROWS], first[low : low + ROWS]
        sums = np.zeros((len(size), table.shape[1]), np.float32)
        for j in range(int(size[0])):
            k = int(np.searchsorted(-size, -j, side="left"))
            at = start[:k] + j
            row = table.take(place[at], axis=0, out=rows[:k], mode="clip")
            row *= values[at][:, None]
            sums[:k] += row
        out[by[low : low + ROWS]] = sums
    return out


def _sketch(flat: np.ndarray, starts: np.ndarray, idf: np.ndarray, omega: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` A'A W of the passages that begin at ``starts``, each as long as up to the next."""
    for low in range(0, len(starts), PASSAGES):
        part = np.r_[starts[low : low + PASSAGES + 1], len(flat)][: PASSAGES + 1]
        n = len(part) - 1
        # unit length for every passage, with repeated words counted together
        key = np.sort(np.repeat(np.arange(n), np.diff(part)) * TERMS + flat[part[0] : part[-1]])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        values = np.diff(np.r_[first, len(key)])
        owner, term = key[first] // TERMS, key[first] & (TERMS - 1)
        values = (values * idf[term]).astype(np.float32)
        norm = np.sqrt(np.bincount(owner, values * values, n))
        values /= np.maximum(norm, 1e-9)[owner].astype(np.float32)
        y = _products(owner, term, values, omega, n)
        frequent = np.argpartition(np.bincount(term, minlength=TERMS), -FREQUENT)[-FREQUENT:]
        row = np.full(TERMS, -1)
        row[frequent] = np.arange(FREQUENT)
        row = row[term]
        many = row >= 0
        dense = np.zeros((FREQUENT, n), np.float32)
        dense[row[many], owner[many]] = values[many]
        total[frequent] += dense @ y
        term, owner, values = term[~many], owner[~many], values[~many]
        order = np.argsort(term.astype(np.uint16), kind="stable")
        term = term[order]
        new = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        some = term[new]
        total[some] += _products(np.cumsum(new) - 1, owner[order], values[order], y, len(some))


def latent_space(docs: DataFrame, idf: np.ndarray, n: int, parts: int, settings: Settings, seed: int = 7) -> np.ndarray:
    """Terms x rank: maps a TF-IDF vector to latent coordinates of unit variance.

    It is fitted to the passages of all documents, in up to eight of their ``parts`` partitions a task, since a task's sum is of
    a fixed size. Only where the caller sets ``settings.sample_docs`` it is fitted to about so many of the ``n`` documents, those
    with the lowest hashes. Each task yields its sum once, cut into blocks of terms, which are added by block; the driver gets the total, whose
    size is fixed by ``TERMS`` and the rank.
    """
    width = settings.rank + settings.beyond

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, total = random_matrix(seed, width), np.zeros((TERMS, width), np.float32)
        for part in slices(batches, "text"):
            flat, lengths = terms_of(part.column("text"))
            if len(flat):
                starts, _, _ = _halves(lengths, 2 * settings.half)
                _sketch(flat.astype(np.int64), starts, idf, omega, total)
        pieces = [total[i : i + TERM_BLOCK].tobytes() for i in range(0, TERMS, TERM_BLOCK)]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array(pieces)], names=["block", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = np.frombuffer(piece.as_buffer(), np.float32)
                sums[block] = sums[block] + value if block in sums else value.astype(np.float64)
        names = ["block", "sums"]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=names)

    if settings.sample_docs is None:
        chosen = pick(docs, "text").coalesce(max(settings.sketches, math.ceil(parts / 8)))
    else:
        share = int(min(1.0, settings.sample_docs / max(n, 1)) * (1 << 30))
        chosen = pick(docs, "doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)
        chosen = chosen.dropDuplicates(["doc_id", "text"])  # rows that repeat share a hash, whatever their number
        chosen = chosen.select("text").repartition(settings.sketches)
    sums = chosen.mapInArrow(run, "block bigint, sums binary").repartition(TERMS // TERM_BLOCK, "block").mapInArrow(add, "block bigint, sums binary")
    product = np.zeros((TERMS // TERM_BLOCK, TERM_BLOCK * width))
    for block, piece in sums.collect():  # TERMS // TERM_BLOCK rows
        product[block] = np.frombuffer(piece)
    return nystrom(product.reshape(TERMS, width), random_matrix(seed, width), settings.rank) * idf[:, None]


def random_matrix(seed: int, width: int) -> np.ndarray:
    """The same in every task, so it need not be sent."""
    return np.random.default_rng(seed).standard_normal((TERMS, width), dtype=np.float32)


def nystrom(product: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors over singular values of A, terms x rank, from A'A W."""
    shift = 1e-6 * max(np.linalg.norm(product), 1e-12)
    shifted = product + shift * omega
    middle = omega.T @ shifted
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    values = np.maximum(values, values.max() * 1e-9)
    half = shifted @ (vectors / np.sqrt(values) @ vectors.T)
    # the left singular vectors of the tall matrix from its small Gram matrix, largest first
    squares, right = np.linalg.eigh(half.T @ half)
    squares, right = np.maximum(squares[::-1], 0), right[:, ::-1]
    eigen = np.maximum(squares - shift, 0)
    keep = eigen > max(eigen.max() * 1e-6, 1e-12)
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, eigen * squares, 1)), 0)
    return (half @ (right * scale)[:, :rank]).astype(np.float32)


def common_subsequence(item: list[bytes], region: list[bytes]) -> int:
    """Length of the longest common subsequence, with the item's words as bits of one number."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    mask = (1 << len(item)) - 1
    row = mask
    for w in region:
        hit = places.get(w)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & mask
    return len(item) - row.bit_count()


@dataclass
class Index:
    """The latent map and a block of the benchmark in it; bounded by the block and ``TERMS``.

    An item has its id, words, answer words, and whether the benchmark gives the answer. ``terms`` are the terms of the
    items' words, ``owners`` the item and the number of its words of each, by term.
    """

    space: np.ndarray
    items: list[tuple[object, list[bytes], list[bytes], bool]]
    latent: np.ndarray
    terms: np.ndarray
    owners: np.ndarray
    item_type: T.DataType = field(default_factory=T.LongType)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _terms(found: list[bytes]) -> np.ndarray:
    return terms_of(pa.array([b" ".join(found).decode("utf-8", "replace")]))[0]


def indices(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> Iterator[Index]:
    """Count terms, factor passages of ``docs``, and place ``benchmark`` in the latent space, a block of items at a time.

    ``benchmark`` has ``item_id, text`` and may have ``answer``. Items without words or id are left out, and items that
    repeat are one, with the smallest answer, null first. Ids keep their type. Without items or words there is one empty index.
    """
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = pick(benchmark, "item_id", "text", *(["answer"] if "answer" in benchmark.columns else []))
    items = items.where("item_id is not null and text is not null").groupBy("item_id", "text")
    items = items.agg(F.min(F.struct(answer.alias("answer")))["answer"].alias("answer"))
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, math.ceil(size["items"] / settings.block_items), math.ceil(size["bytes"] / settings.block_bytes))
    if parts > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    frequencies, n, tasks = document_frequencies(docs)
    kind, space, given = benchmark.schema["item_id"].dataType, None, 0
    for part in range(parts):
        block = items.where(F.col("block") == part) if parts > 1 else items
        found = [(r["item_id"], plain_words(r["text"]), plain_words(r["answer"])) for r in block.orderBy("item_id", "text").collect()]
        found = [row for row in found if row[1]]
        if found and n:
            if space is None:
                space = latent_space(docs, idf_of(frequencies, n), n, tasks, settings)
            given += 1
            yield index_of(found, frequencies, space, settings, kind)
    if not given:
        none = np.zeros((0, settings.rank), np.float32)
        yield Index(np.zeros((TERMS, settings.rank), np.float32), [], none, np.zeros(0, np.int64), np.zeros((0, 2), np.int64), kind)


def index_of(rows: list[tuple], frequencies: np.ndarray, space: np.ndarray, settings: Settings, item_type: T.DataType) -> Index:
    items, pairs = [], []
    for at, (item_id, found, given) in enumerate(rows):
        distinct = sorted(set(given or found))
        terms = _terms(distinct)
        order = np.lexsort((np.arange(len(terms)), frequencies[terms]))[: settings.answer_words]
        items.append((item_id, found, [distinct[i] for i in order], bool(given)))
        pairs += [(int(t), at, int(n)) for t, n in zip(*np.unique(_terms(found), return_counts=True), strict=True)]
    pairs = np.array(sorted(pairs), np.int64)
    latent = np.stack([space[_terms(found)].sum(axis=0) for _, found, *_ in items])
    return Index(space.astype(np.float32), items, _unit(latent).astype(np.float32), pairs[:, 0], pairs[:, 1:], item_type)


def _least(item: tuple, settings: Settings) -> float:
    """Least share of the item's words in common order."""
    return 1.0 if len(item[1]) < settings.short else settings.common


def _covered(flat: np.ndarray, lengths: np.ndarray, index: Index, settings: Settings) -> np.ndarray:
    """Documents x items: whether the document has enough of the item's words, in any order; without them none is in common order."""
    known = np.zeros(TERMS, bool)
    known[index.terms] = True
    at = np.flatnonzero(known[flat])
    key = np.sort(np.repeat(np.arange(len(lengths)), lengths)[at] * TERMS + flat[at])
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    doc, term = key // TERMS, key % TERMS
    first = np.searchsorted(index.terms, term)
    count = np.searchsorted(index.terms, term, side="right") - first
    there = np.zeros(len(lengths) * len(index.items))
    bounds = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + PAIRS, PAIRS), side="right")
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        n = count[low:high]
        place = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(doc[low:high] * len(index.items), n) + index.owners[place, 0]
        there += np.bincount(cell, index.owners[place, 1], len(there))
    least = np.array([_least(item, settings) * len(item[1]) for item in index.items])
    return there.reshape(len(lengths), len(index.items)) >= least - 1e-9


def _half_sums(flat: np.ndarray, starts: np.ndarray, half: int, space: np.ndarray) -> np.ndarray:
    """Sum of the latent rows of the words of each half window, one place of all windows at a time."""
    padded = np.r_[flat.astype(np.int64), np.zeros(half, np.int64)]
    sizes = np.diff(np.r_[starts, len(flat)])
    out = space.take(padded[starts], axis=0)
    row = np.empty_like(out)
    for j in range(1, half):
        if (sizes > j).all():
            out += space.take(padded[starts + j], axis=0, out=row, mode="clip")
        else:
            some = np.flatnonzero(sizes > j)
            out[some] += space.take(padded[starts[some] + j], axis=0)
    return out


def _candidates(texts: pa.Array, index: Index, settings: Settings) -> Iterator[tuple[int, int, int, float]]:
    """(document, item, first word of the window, cosine) of the windows near an item whose document may hold it."""
    flat, lengths = terms_of(texts)
    if not len(flat) or not index.items:
        return
    ends = np.cumsum(lengths)
    some = max(1, CELLS // len(index.items))
    for low in range(0, len(lengths), some):  # so many documents that they and the items are a bounded array
        part = lengths[low : low + some]
        first = int(ends[low] - lengths[low])
        words_ = flat[first : first + int(part.sum())]
        covered = _covered(words_, part, index, settings)
        held = np.flatnonzero(covered.any(axis=1))
        if len(held):
            own = np.repeat(covered.any(axis=1), part)
            yield from ((low + int(held[d]), *rest) for d, *rest in _near(words_[own], part[held], covered[held], index, settings))


def _near(flat: np.ndarray, lengths: np.ndarray, covered: np.ndarray, index: Index, settings: Settings) -> Iterator[tuple[int, int, int, float]]:
    """``_candidates`` of documents of which each has the words of an item, as ``covered`` tells."""
    starts, doc, more = _halves(lengths, settings.half)
    sums = _half_sums(flat, starts, settings.half, index.space)
    windows = sums.copy()
    windows[more] += sums[np.flatnonzero(more) + 1]
    # the last half of a document of several has been in the window before
    where = np.flatnonzero(more | np.r_[True, doc[1:] != doc[:-1]])
    unit = _unit(windows[where])
    base = np.cumsum(lengths) - lengths
    step = max(1, min(4096, CELLS // len(index.items)))
    for i in range(0, len(unit), step):
        near = unit[i : i + step] @ index.latent.T
        at, item = np.nonzero((near >= settings.cosine) & covered[doc[where[i : i + step]]])
        place, cosine = where[i + at], near[at, item]
        own = doc[place]
        start = starts[place] - base[own]
        held = _held(flat, base, lengths, own, item, start, index, settings)
        yield from zip(*(x[held].tolist() for x in (own, item, start, cosine)), strict=True)


def _held(flat: np.ndarray, base: np.ndarray, lengths: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray, index: Index, settings: Settings) -> np.ndarray:
    """Whether the region that ``verify`` looks at has enough of the item's words, in any order, for each window near an item.

    A word counts where it stands first in a region: from the window after the last one that still has the word before it.
    """
    out = np.zeros(len(doc), bool)
    if not len(doc):
        return out
    by_item = np.argsort(index.owners[:, 0], kind="stable")
    bounds = np.searchsorted(index.owners[by_item, 0], np.arange(len(index.items) + 1))
    order = np.lexsort((item, doc))
    pair = doc[order] * len(index.items) + item[order]
    edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True])
    times = np.zeros(TERMS, np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows = order[low:high]
        d, k = doc[rows[0]], item[rows[0]]
        own = by_item[bounds[k] : bounds[k + 1]]
        size = len(index.items[k][1])
        text = flat[base[d] : base[d] + lengths[d]]
        times[index.terms[own]] = index.owners[own, 1]
        found = times[text]
        times[index.terms[own]] = 0
        at = np.flatnonzero(found)
        term, found = text[at], found[at]
        by = np.argsort(term, kind="stable")
        again = np.flatnonzero(term[by[1:]] == term[by[:-1]])
        after = at - 2 * settings.half - size  # the windows that have the place in their region are after this one
        until = at + size  # and up to this one
        after[by[again + 1]] = np.maximum(after[by[again + 1]], until[by[again]])
        entry = np.argsort(after, kind="stable")
        entered, left = np.r_[0, np.cumsum(found[entry])], np.r_[0, np.cumsum(found)]
        n = entered[np.searchsorted(after[entry], start[rows])] - left[np.searchsorted(until, start[rows])]
        out[rows] = n >= _least(index.items[k], settings) * size - 1e-9
    return out


def verify(found: list[bytes], start: int, item: tuple, settings: Settings) -> tuple[float, float]:
    """Shares of the item in common order and of its answer, within an item's length around the window.

    Where too few of the item's words are there for the order to matter, the first share is that of the words there.
    """
    words_, answer = item[1:3]
    region = found[max(0, start - len(words_)) : start + 2 * settings.half + len(words_)]
    there = set(region)
    common = sum(map(there.__contains__, words_)) / len(words_)
    if common >= _least(item, settings):
        common = common_subsequence(words_, region) / len(words_)
    return common, sum(map(there.__contains__, answer)) / len(answer)


def matches(docs: DataFrame, index: Index, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``__items``, an array of (item_id, cosine, common, answer), for every row.

    The best window counts for each item. Whole texts are searched. Null, empty and blank texts match nothing; repeated rows
    match alike; an empty benchmark matches nothing.
    """
    source = pick(docs, *dict.fromkeys([*keep, "text"]))
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    parts = [("item_id", to_arrow_type(index.item_type)), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())]
    kind = pa.list_(pa.struct(parts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text")
            best: list[dict[int, dict]] = [{} for _ in range(len(texts))]
            lists: dict[int, list[bytes]] = {}
            for doc, at, start, cosine in _candidates(texts, index, settings):
                item = index.items[at]
                if doc not in lists:
                    lists[doc] = plain_words(texts[doc].as_py())
                common, answer = verify(lists[doc], start, item, settings)
                if common >= _least(item, settings) and (answer >= settings.answer or not item[3]):
                    row = {"item_id": item[0], "cosine": cosine, "common": common, "answer": answer}
                    old = best[doc].get(at)
                    if old is None or (common, cosine) > (old["common"], old["cosine"]):
                        best[doc][at] = row
            rows = pa.array([[x[k] for k in sorted(x)] for x in best], kind)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), rows], names=[*keep, "__items"])

    return source.mapInArrow(run, ", ".join([*fields, f"__items array<struct<item_id:{index.item_type.simpleString()},cosine:double,common:double,answer:double>>"]))


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, cosine, common, answer``: a row for each document and item that it holds."""
    written, last = [], None
    for index in indices(docs, benchmark, settings):
        if last is not None:  # a block is searched and written before the next one
            written.append(materialize(last, "leaks"))
        last = matches(docs, index, settings).select("doc_id", F.explode("__items").alias("i")).select("doc_id", "i.*")
    return reduce(DataFrame.unionByName, [*written, last])


def keep_clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Rows that a block rejects are not searched again."""
    inner, back = shield(docs, "doc_id", "text")
    left, searched = inner, False
    for index in indices(inner, benchmark, settings):
        left = materialize(left, "clean") if searched else left
        out = matches(left, index, settings, tuple(inner.columns))
        left, searched = out.where(F.size("__items") == 0).drop("__items"), True
    return left.select(*back)
