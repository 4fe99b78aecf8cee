"""Packing: token sequences of a fixed size from documents, planned on the histogram of lengths alone.

Every document is cut into whole sequences and a rest. The rests are packed shortest pack first: lengths are placed
longest first, all documents of a length at once, each into the shortest pack that is open, or into new packs when it
does not fit there. Packs with the same contents are one pattern with a count, so the plan has a few patterns for each
length, however many documents there are; a document's rank among those of its length tells its pattern and place.

Where lengths do not fit together (a hot length of 1100 leaves 948 of 2048 empty), whole rests would be padded. So the
emptiest packs are taken apart again, as many as fit the gaps of the others: their documents are one stream, cut where
a gap is full. Gaps below ``least`` are left, lest a document is cut to crumbs.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import pick, slices
from millrace.llm.tokens import PIECES
from millrace.session import materialize, new_folder

ID = np.dtype("<u4")


# --- token ids --------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Files of one byte-level vocabulary: the tokenizer itself, and the same ranks for the faster encoder."""

    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as the tokenizer gives them. Texts that name one of its special tokens go to the tokenizer itself, all others
    to an encoder of the same merges, which is three times as fast."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        from tiktoken.load import load_tiktoken_bpe

        self.tokenizer = Tokenizer.from_file(vocabulary.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = load_tiktoken_bpe(vocabulary.ranks)
        self.fast = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(
    docs: DataFrame, size: int, vocabulary: Vocabulary = Vocabulary(), stop: int = 1, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Write the token ids of all texts, in pieces of ``size`` and a rest, and read them back.

    The ``keep`` columns, ``__start``, ``__length``, ``__doc_tokens``, ``__ids`` (unsigned 32-bit, little-endian), and
    ``__task`` and ``__nth``: the piece is the nth of its length in that task. Written once, so a lost executor
    changes no number. ``stop`` closes each document; null texts have nothing else.
    """
    source = pick(docs, *dict.fromkeys([*keep, "text"]))
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    added = ["__start", "__length", "__doc_tokens", "__ids", "__task", "__nth"]
    types = ["bigint", "bigint", "bigint", "binary", "int", "bigint"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for part in slices(batches, "text"):
            ids = [np.array([*encoder.ids(t or ""), stop], ID).tobytes() for t in part.column("text").to_pylist()]
            totals = np.array([len(b) // ID.itemsize for b in ids], np.int64)
            count = -(-totals // size)
            row = np.repeat(np.arange(len(ids)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
            length = np.minimum(totals[row] - start, size)
            by = np.argsort(length, kind="stable")
            nth = np.empty(len(row), np.int64)
            nth[by] = np.arange(len(row)) - np.searchsorted(length[by], length[by]) + seen[length[by]]
            seen += np.bincount(length, minlength=size + 1)
            cut = [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [part.column(c).take(pa.array(row)) for c in keep]
            columns += [pa.array(start), pa.array(length), pa.array(totals[row]), pa.array(cut, pa.binary())]
            columns += [pa.array(np.full(len(row), task, np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    schema = ", ".join([*fields, *[f"`{n}` {t}" for n, t in zip(added, types, strict=True)]])
    out = source.mapInArrow(run, schema)
    folder = new_folder(docs.sparkSession, "pieces")
    out.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


# --- the plan ---------------------------------------------------------------------------


@dataclass
class Pack:
    """``count`` packs with the same ``lengths``, in the order they were placed."""

    count: int
    fill: int
    lengths: tuple | None  # (length, the lengths before it)

    def contents(self) -> list[tuple[int, int]]:
        """(length, how many) in order; equal lengths stand together, since lengths only fall."""
        found: Counter[int] = Counter()
        chain, order = self.lengths, []
        while chain is not None:
            order.append(chain[0])
            chain = chain[1]
        found.update(reversed(order))
        return list(found.items())


def shortest_pack_first(histogram: np.ndarray, size: int) -> list[Pack]:
    """Packs for ``histogram[length]`` documents of each length up to ``size``.

    Placing a length fills whole patterns, splits one at most and opens two kinds of new packs at most, so there are no
    more than three patterns a length.
    """
    packs: list[tuple[int, int, Pack]] = []
    made = 0

    def push(count: int, fill: int, lengths: tuple | None) -> None:
        nonlocal made
        if count:
            made += 1
            heapq.heappush(packs, (fill, made, Pack(count, fill, lengths)))

    for length in range(size, 0, -1):
        left = int(histogram[length])
        while left and packs and packs[0][0] + length <= size:
            pack = heapq.heappop(packs)[2]
            moved = min(left, pack.count)
            push(moved, pack.fill + length, (length, pack.lengths))
            push(pack.count - moved, pack.fill, pack.lengths)
            left -= moved
        # no open pack has room: each new pack is the shortest until this length does not fit into it any more
        each = size // length
        for count, inside in ((left // each, each), (1, left % each)):
            chain = None
            for _ in range(inside):
                chain = (length, chain)
            if inside:
                push(count, inside * length, chain)
    return [entry[2] for entry in sorted(packs, key=lambda e: (-e[0], e[1]))]


@dataclass
class Plan:
    """Where each (length, rank) goes. All arrays are bounded by ``size``, not by the number of documents."""

    size: int
    # places of whole pieces: by length and first rank
    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    many: np.ndarray
    offset: np.ndarray
    # pieces from this rank on are one stream, by length; the place of their first token in it
    loose_from: np.ndarray
    loose_at: np.ndarray
    # gaps that the stream fills: where each kind begins in the stream, its gaps before, size, first sequence, offset
    gap_at: np.ndarray
    gap_before: np.ndarray
    gap_size: np.ndarray
    gap_sequence: np.ndarray
    gap_offset: np.ndarray

    def whole(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces that are not cut."""
        big = int(self.rank.max(initial=0) + rank.max(initial=0)) + 1
        at = np.searchsorted(self.length * big + self.rank, length * big + rank, side="right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.many[at], self.offset[at] + nth % self.many[at] * length

    def cut(self, length: np.ndarray, rank: np.ndarray):
        """Row, first token, tokens, sequence and offset of the fragments of pieces of the stream."""
        begin = self.loose_at[length] + (rank - self.loose_from[length]) * length

        def gap_of(x: np.ndarray) -> np.ndarray:
            kind = np.searchsorted(self.gap_at, x, side="right") - 1
            return self.gap_before[kind] + (x - self.gap_at[kind]) // self.gap_size[kind]

        first = gap_of(begin)
        count = gap_of(begin + length - 1) - first + 1
        row = np.repeat(np.arange(len(length)), count)
        gap = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        kind = np.searchsorted(self.gap_before, gap, side="right") - 1
        left = self.gap_at[kind] + (gap - self.gap_before[kind]) * self.gap_size[kind]
        start = np.maximum(left, begin[row])
        stop = np.minimum(left + self.gap_size[kind], begin[row] + length[row])
        sequence = self.gap_sequence[kind] + gap - self.gap_before[kind]
        return row, start - begin[row], stop - start, sequence, self.gap_offset[kind] + start - left


def plan(histogram: np.ndarray, size: int, least: int = 16) -> Plan:
    """Pack ``histogram``, take the emptiest packs apart as far as the gaps of the others hold them, number the rest."""
    packs = shortest_pack_first(histogram, size)
    gapped = sorted((p for p in packs if size - p.fill >= least), key=lambda p: p.fill)
    room = sum(p.count * (size - p.fill) for p in gapped)
    taken: list[tuple[int, Pack]] = []
    tokens = 0
    for pack in gapped:
        # a pack taken apart brings its tokens and takes its own gap away: ``size`` together
        count = min(pack.count, (room - tokens) // size)
        taken.append((count, pack))
        tokens += count * pack.fill
        room -= count * (size - pack.fill)
        pack.count -= count
        if pack.count:
            break
    loose = np.zeros(size + 1, np.int64)
    for count, pack in taken:
        for length, many in pack.contents():
            loose[length] += count * many
    next_rank = np.zeros(size + 1, np.int64)
    places, gaps = [], []
    sequence = 0
    for pack in packs:
        if not pack.count:
            continue
        offset = 0
        for length, many in pack.contents():
            places.append((length, int(next_rank[length]), sequence, many, offset))
            next_rank[length] += pack.count * many
            offset += length * many
        if size - pack.fill >= least:
            gaps.append((size - pack.fill, pack.count, sequence, pack.fill))
        sequence += pack.count
    lengths = np.arange(size + 1)
    at = np.cumsum((loose * lengths)[::-1])[::-1] - loose * lengths  # the longest come first
    gaps.sort(key=lambda g: (-g[0], g[2]))
    gap_size, gap_count, gap_sequence, gap_offset = np.array(gaps, np.int64).reshape(-1, 4).T
    by_place = np.array(sorted(places), np.int64).reshape(-1, 5).T
    return Plan(
        size,
        *by_place,
        next_rank,
        at,
        np.cumsum(gap_size * gap_count) - gap_size * gap_count,
        np.cumsum(gap_count) - gap_count,
        gap_size,
        gap_sequence,
        gap_offset,
    )


# --- documents to places ----------------------------------------------------------------


def place(tokens: DataFrame, size: int, least: int = 16, ids: bool = False) -> DataFrame:
    """Where each of the written ``pieces`` goes: ``__start``, ``__length``, ``__ids_crc32``, ``__doc_tokens``,
    ``__sequence`` and ``__offset`` beside the kept columns, and ``__ids`` if asked for.

    Ranks are counted per task and length, then added up over the tasks of a length: no window holds more rows than
    there are tasks. Only the ids of pieces that are cut again leave their scan, unless all are asked for.
    """
    counts = tokens.groupBy("__task", "__length").agg(F.count(F.lit(1)).alias("__many"))
    before = W.partitionBy("__length").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    firsts = materialize(counts.withColumn("__first", F.coalesce(F.sum("__many").over(before), F.lit(0))), "ranks")
    histogram = np.zeros(size + 1, np.int64)
    for row in firsts.groupBy("__length").agg(F.sum("__many").alias("n")).collect():  # a row for each length
        histogram[row["__length"]] = row["n"]
    scheme = plan(histogram, size, least)

    keep = [c for c in tokens.columns if not c.startswith("__")]
    wide = F.lit(ids) | _of_stream(firsts, scheme, histogram)
    narrow = tokens.select(
        *[F.col(f"`{c}`") for c in keep],
        *["__start", "__length", "__doc_tokens", "__task", "__nth"],
        F.crc32("__ids").alias("__ids_crc32"),
        F.when(wide, F.col("__ids")).alias("__ids"),
    )
    ranked = narrow.join(firsts.select("__task", "__length", "__first"), ["__task", "__length"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__nth"))
    names = [*keep, "__start", "__length", "__ids_crc32", "__doc_tokens", "__sequence", "__offset"] + ["__ids"] * ids
    ranked = ranked.select(*[F.col(f"`{c}`") for c in keep], "__start", "__length", "__ids_crc32", "__doc_tokens", "__rank", "__ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__ids", 8 << 20):
            start, length, crc, rank = (batch.column(c).to_numpy() for c in ("__start", "__length", "__ids_crc32", "__rank"))
            is_loose = rank >= scheme.loose_from[length]
            whole, cut = np.flatnonzero(~is_loose), np.flatnonzero(is_loose)
            sequence, offset = scheme.whole(length[whole], rank[whole])
            columns = [whole, start[whole], length[whole], crc[whole], sequence, offset]
            values = batch.column("__ids").take(pa.array(whole)).to_pylist() if ids else []
            if len(cut):
                row, skip, many, cut_sequence, cut_offset = scheme.cut(length[cut], rank[cut])
                row = cut[row]
                texts = {k: batch.column("__ids")[k].as_py() for k in cut.tolist()}
                fragments = [texts[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), skip.tolist(), many.tolist(), strict=True)]
                crcs = np.array([zlib.crc32(f) for f in fragments], np.int64)
                more = [row, start[row] + skip, many, crcs, cut_sequence, cut_offset]
                columns = [np.concatenate(pair) for pair in zip(columns, more, strict=True)]
                values += fragments if ids else []
            at, start, length, crc, sequence, offset = columns
            rows = pa.array(at)
            out = [batch.column(c).take(rows) for c in keep] + [pa.array(start), pa.array(length), pa.array(crc)]
            out += [batch.column("__doc_tokens").take(rows), pa.array(sequence), pa.array(offset)] + [pa.array(values, pa.binary())] * ids
            yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name in keep]
    return ranked.mapInArrow(run, ", ".join([*fields, *[f"`{n}` bigint" for n in names[len(keep) : len(keep) + 6]], *["`__ids` binary"] * ids]))


def _of_stream(firsts: DataFrame, scheme: Plan, histogram: np.ndarray) -> Column:
    """Whether a piece is cut again, told from its task and its place there: ranks follow tasks."""
    begins = F.element_at(F.lit(scheme.loose_from[1:].tolist()).cast("array<bigint>"), F.col("__length").cast("int"))
    with_stream = np.flatnonzero(scheme.loose_from < histogram).tolist()
    edge = firsts.where(F.col("__length").isin(with_stream) & (F.col("__first") <= begins) & (begins < F.col("__first") + F.col("__many")))
    tasks, places = [1 << 31] * scheme.size, [0] * scheme.size
    for row in edge.select("__length", "__task", (begins - F.col("__first")).alias("nth")).collect():  # a row for each length
        tasks[row["__length"] - 1], places[row["__length"] - 1] = row["__task"], row["nth"]
    task, nth = (F.element_at(F.lit(x).cast("array<bigint>"), F.col("__length").cast("int")) for x in (tasks, places))
    return (F.col("__task") > task) | ((F.col("__task") == task) & (F.col("__nth") >= nth))


def pack(
    docs: DataFrame,
    size: int = 2048,
    vocabulary: Vocabulary = Vocabulary(),
    stop: int = 1,
    least: int = 16,
    keep: Sequence[str] = ("doc_id",),
    ids: bool = False,
) -> DataFrame:
    """Pack the tokens of all ``docs`` into sequences of at most ``size``: one row for each piece of a document.

    Null and empty texts are the ``stop`` id alone. Repeated rows are packed each; ids of documents may be null. An
    empty table gives an empty one.
    """
    return place(pieces(docs, size, vocabulary, stop, keep), size, least, ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``__sequence``, ``__n`` and its ``__ids`` from pieces that carry their ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("__offset", "__length", "__ids")))
    grouped = packed.groupBy("__sequence").agg(F.sum("__length").alias("__n"), parts.alias("__parts"))
    joined = F.aggregate("__parts", F.lit(b""), lambda a, p: F.concat(a, p["__ids"]))
    return grouped.select("__sequence", "__n", joined.alias("__ids"))


def packing_report(docs: DataFrame, size: int = 2048) -> DataFrame:
    out = pack(docs, size)
    names = {"__start": "start", "__length": "length", "__ids_crc32": "ids_crc32", "__doc_tokens": "doc_tokens"}
    names |= {"__sequence": "sequence_id", "__offset": "offset"}
    return out.select("doc_id", *[F.col(old).alias(new) for old, new in names.items()])
