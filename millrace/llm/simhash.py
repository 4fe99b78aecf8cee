"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most 3 are looked for as follows. The bits are cut into three
blocks. Without the block that holds most of the differing bits, at most two differ, so the two balls of half
that radius, one bit, around the remaining 42 or 43 bits share a point. Every distinct fingerprint therefore emits,
for each left-out block, its remaining bits and all variants with one of them flipped (131 in all), variants are
shuffled together, and fingerprints that meet at a variant are verified on all 64 bits. In general a radius r with
b blocks leaves at most r - ceil(r / b) bits, and the balls have half that radius, rounded up.

Balls of half the radius around the whole 64 bits need a ball of radius 2 on one side, 2081 variants a fingerprint;
leaving out a block costs a verification instead, and a sixteenth of the shuffle.

No pairs are emitted. Tasks read the variants in order, compare those that meet, and emit for each fingerprint one
edge to the smallest fingerprint it is connected with at that variant.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import pick, shield, slices, words
from millrace.llm.components import connected_components
from millrace.session import materialize

BITS = 64
SEED = 42


def shingle_hashes(text: str | None, length: int) -> list[int]:
    """XXH64 of each run of ``length`` words, A-Z lower-cased, joined by spaces; fewer words make one run."""
    found = [w.lower() for w in words(text)]  # lower() of bytes changes A-Z only
    if not found:
        return []
    hash_ = xxhash.xxh64_intdigest
    if len(found) < length:
        return [hash_(b" ".join(found), SEED)]
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.r_[0, ends[:-1]][: len(found) - length + 1]
    return [hash_(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[length - 1 :] - 1).tolist(), strict=True)]


def fingerprints_of(texts: list[str | None], length: int) -> np.ndarray:
    """One unsigned fingerprint per text; a bit is set if more than half of the hashes set it."""
    hashes = [shingle_hashes(t, length) for t in texts]
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    flat = np.fromiter((h for x in hashes for h in x), np.dtype("<u8"), int(n.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = (np.cumsum(n) - n)[some]
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    majority = (2 * counts > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, length: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``__fp``, a signed long, for every row. Null and blank texts get zero."""
    source = pick(docs, *dict.fromkeys([*keep, "text"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*[F.col(f"`{c}`") for c in keep]).schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = fingerprints_of(part.column("text").to_pylist(), length).view(np.int64)
            columns = [*(part.column(c) for c in keep), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__fp"])

    return source.mapInArrow(run, ", ".join([*fields, "__fp bigint"]))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def ball(radius: int, blocks: int = 3) -> list[tuple[int, int]]:
    """(mask of the left-out bits, bits to flip) of every variant that a fingerprint emits."""
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    left = radius - -(-radius // blocks)
    half = -(-left // 2)
    out = []
    for start, stop in zip(bounds, bounds[1:], strict=False):
        dropped = ((1 << stop) - (1 << start)) & ((1 << BITS) - 1)
        kept = [j for j in range(BITS) if not start <= j < stop]
        for size in range(half + 1):
            out += [(_signed(dropped), _signed(sum(1 << j for j in flip))) for flip in combinations(kept, size)]
    return out


def variants(fps: DataFrame, radius: int, blocks: int = 3) -> DataFrame:
    """``(key, fp)``: every fingerprint under all points of its balls; the left-out bits of a key are set."""
    points = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(x).alias("x")) for d, x in ball(radius, blocks)])
    spread = fps.select("fp", F.explode(points).alias("p"))
    return spread.select(F.col("fp").bitwiseOR(F.col("p.d")).bitwiseXOR(F.col("p.x")).alias("key"), "fp")


#: Fingerprints under one key from which they are split by further bits before they are compared.
LARGE = 256


def meet(keys: np.ndarray, fps: np.ndarray, radius: int, large: int = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest one connected with it) among those with equal keys, which stand together.

    A large group is split first: of ``radius + 1`` bands of the bits in which its members differ, two that are linked
    share one at least, so only those that share a band are compared. Memory is linear.
    """
    n = len(keys)
    root = np.arange(n)
    bits = fps.view(np.uint64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    small = np.flatnonzero(np.repeat(sizes <= large, sizes))
    _compare(root, small, keys[small], bits, radius)
    for start, size in zip(first[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
        here = np.arange(start, start + size)
        differ = int(np.bitwise_or.reduce(bits[here] ^ bits[start]))
        places = [k for k in range(64) if differ >> k & 1]
        for band in range(radius + 1):
            mask = np.uint64(sum(1 << k for k in places[band :: radius + 1]))
            value = bits[here] & mask
            order = np.argsort(value, kind="stable")
            _compare(root, here[order], value[order], bits, radius)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def _compare(root: np.ndarray, rows: np.ndarray, labels: np.ndarray, bits: np.ndarray, radius: int) -> None:
    """Connect rows with equal labels, which stand together: each is compared with the one d places on, d = 1, 2, ..."""
    n = len(rows)
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < n]
        at = at[labels[at] == labels[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count(bits[rows[at]] ^ bits[rows[at + d]]) <= radius]
        a, b = rows[near], rows[near + d]
        apart = root[a] != root[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            low, high = sorted((_find(root, i), _find(root, j)))
            root[high] = low
        while apart.any() and not np.array_equal(root[root], root):
            root[:] = root[root]
        d += 1


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = int(root[i])
    return i


def links(fps: DataFrame, radius: int, blocks: int = 3) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints within ``radius`` bits of each other."""
    dealt = variants(fps, radius, blocks).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            found = np.r_[found, batch.column(1).to_numpy()]
            cut = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0  # the last key may go on
            yield _edges(keys[:cut], found[:cut], radius)
            keys, found = keys[cut:], found[cut:]
        yield _edges(keys, found, radius)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _edges(keys: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = keys[1:] == keys[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    a, b = meet(keys[same], fps[same], radius)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def classes(docs: DataFrame, length: int, radius: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, root, component_id)`` of every distinct fingerprint; both written."""
    rows = fingerprints(docs, length).select(F.col("doc_id").alias("id"), F.col("__fp").alias("fp"))
    rows = materialize(rows, "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = materialize(connected_components(links(distinct.select("fp"), radius, blocks)), "roots")
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    member = member.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, materialize(member.join(lowest, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, length: int = 3, radius: int = 3, blocks: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id
    that is reachable. Equal texts share a fingerprint, so copies are never compared: distinct fingerprints
    stand for them, and a row finds its component by its fingerprint. Null, empty and blank texts have fingerprint
    zero and are linked like any other. Null ids are kept; a component without any id has a null ``component_id``.
    Repeated rows come back repeated; an empty table gives an empty one.
    """
    rows, found = classes(docs, length, radius, blocks)
    out = rows.join(found.select("fp", "component_id"), "fp")
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, length: int = 3, radius: int = 3, blocks: int = 3) -> DataFrame:
    """One row of each component, that of its smallest id, with all columns of ``docs``.

    Rows that repeat that id are copies of it, and one of them stays. A component without ids keeps one row.
    """
    inner, back = shield(docs, "doc_id", "text")
    _, found = classes(inner, length, radius, blocks)
    first = found.where("component_id is not null").select(F.col("component_id").alias("__keep")).distinct()
    named = inner.join(first, inner["doc_id"] == first["__keep"], "left_semi").dropDuplicates(["doc_id"])
    unnamed = fingerprints(inner.where("doc_id is null"), length, tuple(inner.columns))
    nameless = found.where("component_id is null").select(F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    unnamed = unnamed.join(nameless, "__fp").dropDuplicates(["__root"]).select(*inner.columns)
    return named.unionByName(unnamed).select(*back)
