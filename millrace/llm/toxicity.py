"""Toxicity by a linear-chain conditional random field over words.

The field has two states, clean and toxic. Words of the labelled sample are marked toxic if they are far more frequent
in toxic documents than in clean ones; the field learns from those marks and the words around them. For a whole text,
forward-backward gives the marginal probability of the toxic state at each word; runs of words above one half are the
offending spans, and a logistic of the highest marginal and the expected number of toxic words is the document's score.

Forward and backward ratios of two states follow r' = (a + b r) / (c + d r). Those maps compose as 2 x 2 matrices,
so all texts of a slice run as one chain in blocks: matrices of the blocks, a carry from block to block, then the
blocks again from their carries. The result is exact at any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ByteWords, byte_words, pick, shield, slices

#: Kinds of feature: the word, its first 4 and 5 bytes, its last 4, the word before and the word after.
KINDS = 6
OWN = 4
SALTS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(KINDS)], np.uint64)
#: Bits of the filter that tells most words without a weight apart.
FILTER_BITS = 22


@dataclass
class Model:
    """Weights by hash of the feature (in order), transitions (clean to toxic, toxic to clean, toxic to toxic), and the
    logistic of the document score."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    transitions: tuple[float, float, float] = (0.0, 0.0, 0.0)
    logistic: tuple[float, ...] = (-4.0, 0.0, 0.0)


def features(found: ByteWords) -> np.ndarray:
    """Hashes of the ``OWN`` features of every word, a row for each kind."""
    start, end = found.start, found.end
    own = [
        found.hashes(start, end),
        found.hashes(start, np.minimum(start + 4, end)),
        found.hashes(start, np.minimum(start + 5, end)),
        found.hashes(np.maximum(end - 4, start), end),
    ]
    return np.stack(own) ^ SALTS[:OWN, None] if len(start) else np.zeros((OWN, 0), np.uint64)


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, block: int = 64) -> np.ndarray:
    """r[t] = (a[t] + b[t] r[t-1]) / (c[t] + d[t] r[t-1]) from r[-1] = 1, in blocks of one step each over all blocks."""
    n = len(a)
    blocks = -(-n // block)
    shape = lambda x, fill: np.r_[x, np.full(blocks * block - n, fill)].reshape(blocks, block).T
    a, b, c, d = shape(a, 0.0), shape(b, 1.0), shape(c, 1.0), shape(d, 0.0)
    p, q, u, v = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)  # r -> (p r + q) / (u r + v)
    for k in range(block):
        p, q, u, v = b[k] * p + a[k] * u, b[k] * q + a[k] * v, d[k] * p + c[k] * u, d[k] * q + c[k] * v
        norm = np.maximum(np.maximum(p, q), np.maximum(u, v))
        p, q, u, v = p / norm, q / norm, u / norm, v / norm
    carry, r = np.empty(blocks), 1.0
    for k, (x, y, z, w) in enumerate(zip(p.tolist(), q.tolist(), u.tolist(), v.tolist(), strict=True)):
        carry[k] = r
        r = (x * r + y) / (z * r + w)
    out = np.empty((block, blocks))
    for k in range(block):
        carry = (a[k] + b[k] * carry) / (c[k] + d[k] * carry)
        out[k] = carry
    return out.T.ravel()[:n]


def forward_backward(
    scores: np.ndarray, starts: np.ndarray, transitions: tuple[float, float, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic / clean of the forward and of the backward variables at every word.

    ``scores`` is how much the toxic state is favoured at a word, ``starts`` marks the first word of each text.
    """
    m01, m10, m11 = (float(np.exp(x)) for x in transitions)
    psi = np.exp(np.clip(scores, -30, 30))
    inner = ~starts
    forward = scan(psi * np.where(inner, m01, 1.0), psi * m11 * inner, np.ones(len(psi)), m10 * inner)
    ends = np.r_[starts[1:], True]
    after = np.where(ends, 0.0, np.r_[psi[1:], 1.0])
    # at an end the ratio is 1; else (m10 + m11 psi q) / (1 + m01 psi q)
    backward = scan(
        np.where(ends, 1.0, m10)[::-1], (m11 * after)[::-1], np.ones(len(psi)), (m01 * after)[::-1]
    )[::-1]
    return forward, backward


def neighbours(word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words before and after, 0 at the edges of a text; ``word`` are the words' hashes."""
    plain = word ^ SALTS[0]
    before = np.where(starts, np.uint64(0), np.r_[np.uint64(0), plain[:-1] ^ SALTS[4]])
    after = np.where(np.r_[starts[1:], True], np.uint64(0), np.r_[plain[1:] ^ SALTS[5], np.uint64(0)])
    return before, after


def train(
    own: np.ndarray, starts: np.ndarray, marks: np.ndarray, rounds: int = 80, rate: float = 0.3, l2: float = 1e-3, least: int = 3
) -> Model:
    """Weights that maximise the conditional likelihood of the marked words, by Adam on the whole sample.

    ``own`` are the feature hashes of all words of the sample's windows. Features that occur fewer than ``least``
    times are left out, and so are weights that end up near zero.
    """
    n = own.shape[1]
    if not n:
        return Model()
    before, after = neighbours(own[0], starts)
    stacked = np.concatenate([*own, before, after])
    keys, inverse, counts = np.unique(stacked, return_inverse=True, return_counts=True)
    kept = (counts >= least) & (keys != 0)
    place = np.where(kept, np.cumsum(kept), 0)  # 0: no weight
    columns = list(place[inverse].reshape(KINDS, n))
    keys, size = keys[kept], int(kept.sum()) + 1
    weights, bias, trans = np.zeros(size), -3.0, np.zeros(3)
    first, second = np.zeros(size + 4), np.zeros(size + 4)
    y = marks.astype(float)
    inner = np.flatnonzero(~starts)
    real = np.array([(1 - y[inner - 1]) @ y[inner], y[inner - 1] @ (1 - y[inner]), y[inner - 1] @ y[inner]])
    for step in range(1, rounds + 1):
        scores = bias + sum(weights[c] for c in columns)
        f, q = forward_backward(scores, starts, tuple(trans))
        p = f * q / (1 + f * q)
        # pairs of states at neighbouring words
        m01, m10, m11 = np.exp(trans)
        alpha, psi, beta = f[inner - 1], np.exp(np.clip(scores[inner], -30, 30)), q[inner]
        w01, w10, w11 = m01 * psi * beta, alpha * m10, alpha * m11 * psi * beta
        total = 1 + w01 + w10 + w11
        miss = y - p
        grad = np.zeros(size + 4)
        for c in columns:
            grad[:size] += np.bincount(c, miss, size)
        grad[size] = miss.sum()
        grad[size + 1 :] = real - [(w / total).sum() for w in (w01, w10, w11)]
        theta = np.r_[weights, bias, trans]
        grad -= l2 * theta * n**0.5
        grad[0] = 0
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bias, trans = theta[:size], theta[size], np.clip(theta[size + 1 :], -8, 8)
    strong = np.abs(weights[1:]) > 0.05
    return Model(keys[strong], weights[1:][strong], float(bias), tuple(float(x) for x in trans))


class Tagger:
    """A model with a filter of its keys; made in each task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(model.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        at = np.flatnonzero(self.filter[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.searchsorted(self.model.keys, keys[at])
        place = np.minimum(place, len(self.model.keys) - 1)
        real = self.model.keys[place] == keys[at]
        scores[at[real]] += self.model.weights[place[real]]

    def marginals(self, found: ByteWords) -> np.ndarray:
        """Probability of the toxic state at each word of all texts."""
        if not len(found.start):
            return np.zeros(0)
        starts = found.firsts()
        scores = np.full(len(starts), self.model.bias)
        if len(self.model.keys):
            own = features(found)
            for keys in (*own, *neighbours(own[0], starts)):
                self._add(scores, keys)
        f, q = forward_backward(scores, starts, self.model.transitions)
        odds = f * q
        return odds / (1 + odds)

    def evidence(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Highest marginal of each text, and the logarithm of 1 + its sum of marginals of one half or more."""
        out = np.zeros((len(lengths), 2))
        some = np.flatnonzero(lengths)
        if len(some):
            starts = (np.cumsum(lengths) - lengths)[some]
            out[some, 0] = np.maximum.reduceat(p, starts)
            out[some, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0.0), starts))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        w = self.model.logistic
        return 1 / (1 + np.exp(-np.clip(w[0] + evidence @ np.array(w[1:]), -30, 30)))


def spans(found: ByteWords, p: np.ndarray, raw: list[bytes | None]) -> list[list[dict[str, int]]]:
    """Per text the character offsets [start, end) of the runs of words whose marginal is at least one half."""
    out: list[list[dict[str, int]]] = [[] for _ in raw]
    toxic = p >= 0.5
    doc = np.repeat(np.arange(len(raw)), found.lengths)
    first = toxic & ~(np.r_[False, toxic[:-1]] & ~found.firsts()) if len(p) else toxic
    opens = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    closes = np.zeros(len(opens), np.int64)
    closes[run[toxic]] = np.flatnonzero(toxic)  # the last word of a run stays
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        base = int(found.offsets[doc[a]])
        text = raw[doc[a]]
        at = [len(text[: int(x) - base].decode("utf-8", "replace")) for x in (found.start[a], found.end[b])]
        out[doc[a]].append({"start": at[0], "end": at[1]})
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 50) -> tuple[float, float, float]:
    """Weights of a regularised logistic regression by Newton steps."""
    data = np.c_[np.ones(len(x)), x]
    w = np.zeros(data.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        curve = (data * (p * (1 - p))[:, None]).T @ data + l2 * np.eye(len(w))
        step = np.linalg.solve(curve, data.T @ (y - p) - l2 * w)
        w = w + step / max(1.0, np.abs(step).max() / 5)
    return tuple(float(v) for v in w)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    where: Column | None = None,
    sample_docs: int = 1000,
    window: int = 120,
    odds: float = 4.0,
) -> Model:
    """Learn from at most ``sample_docs`` labelled documents of each class, of any length.

    This bounds the sample, which the driver holds; its documents are those with the lowest hash of
    ``doc_id`` among those that are labelled and pass ``where``. Several labels of a document count as toxic if one is. A
    word is marked in toxic documents if the logarithm of the ratio of the shares of toxic and clean documents that have
    it, or its first four or five letters, is at least ``odds``, and one in fifty toxic ones have it; of near copies one
    counts. The field learns from ``window`` words around a mark, or from the middle of a text
    without one. Without toxic or without clean documents the model finds nothing.
    """
    rows = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    if where is not None:
        rows = rows.where(where)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    both = rows.select("doc_id").distinct().join(known, "doc_id").withColumn("hash", F.xxhash64("doc_id"))  # without texts
    wanted: dict[int, int] = {}
    for value in (1, 0):
        sample = both.where((F.col("toxic") > 0) == F.lit(bool(value))).orderBy("hash", "doc_id").limit(sample_docs)
        wanted |= {row[0]: value for row in sample.select("doc_id").collect()}
    found = rows.where(F.col("doc_id").isin(list(wanted))).collect() if wanted else []
    found = sorted({row[0]: row[1] for row in found}.items())  # a repeated id counts once
    texts, toxic = [text for _, text in found], [wanted[i] for i, _ in found]
    return learn(texts, np.array(toxic, np.int64), window, odds)


def distinct(word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the texts whose lowest hash of three words in a row is not that of an earlier one: of copies the first."""
    ends = np.cumsum(lengths)
    three = word.copy()
    for k in (1, 2):
        three ^= np.r_[word[k:], np.zeros(min(k, len(word)), np.uint64)] * np.uint64(2 * k + 1)
    lowest = [int(three[e - n : max(e - 2, e - n + 1)].min()) if n else -1 for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    return np.sort(np.unique(np.array(lowest, object), return_index=True)[1])


def _document_counts(own: np.ndarray, doc: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and the number of kept documents that have each."""
    keys, counts = [], []
    for each in own[:, keep[doc]]:
        pairs = (each ^ (each >> np.uint64(29))) * SALTS[1] + doc[keep[doc]].astype(np.uint64) * SALTS[2]
        once = each[np.unique(pairs, return_index=True)[1]]
        for out, value in zip((keys, counts), np.unique(once, return_counts=True), strict=True):
            out.append(value)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _slices(texts: list[str]) -> Iterator[ByteWords]:
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    for part in slices([whole], "text"):
        yield byte_words(part.column("text"))


def learn(texts: list[str], toxic: np.ndarray, window: int = 120, odds: float = 4.0) -> Model:
    """A model from labelled texts; only the hashes of their words are held, not the arrays they come from."""
    parts = [(features(found), found.lengths) for found in _slices(texts)]
    own = np.concatenate([p for p, _ in parts], axis=1) if parts else np.zeros((OWN, 0), np.uint64)
    lengths = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
    del parts
    chosen = distinct(own[0], lengths)
    kept = np.zeros(len(texts), bool)
    kept[chosen] = True
    own, lengths, toxic = own[:, np.repeat(kept, lengths)], lengths[chosen], toxic[chosen] > 0
    texts = [texts[i] for i in chosen]
    if not toxic.any() or toxic.all():
        return Model()
    doc = np.repeat(np.arange(len(texts)), lengths)
    bad, with_bad = _document_counts(own[:3], doc, toxic)
    clean, with_clean = _document_counts(own[:3], doc, ~toxic)
    at = np.minimum(np.searchsorted(clean, bad), max(len(clean) - 1, 0))
    other = np.where(clean[at] == bad, with_clean[at], 0) if len(clean) else np.zeros(len(bad))
    gain = np.log((with_bad + 0.1) / (toxic.sum() + 1)) - np.log((other + 0.1) / ((~toxic).sum() + 1))
    bad = bad[(with_bad >= max(4, 0.02 * toxic.sum())) & (gain >= odds)]
    marks = toxic[doc] & np.isin(own[:3], bad).any(axis=0)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    middle = lengths // 2
    marked = np.flatnonzero(marks)[::-1]
    middle[doc[marked]] = place[marked]  # the first mark of a text stays
    inside = np.abs(place - middle[doc]) < window // 2
    starts = np.r_[True, doc[inside][1:] != doc[inside][:-1]]
    model = train(own[:, inside], starts, marks[inside])
    tagger = Tagger(model)
    evidence = [tagger.evidence(tagger.marginals(found), found.lengths) for found in _slices(texts)]
    model.logistic = fit_logistic(np.concatenate(evidence), toxic.astype(float))
    return model


def tag(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``__score`` and ``__spans`` (character offsets) for every row of ``docs``.

    Whole texts are tagged. Null, empty and blank texts have no word: no span, and the score of no evidence. Scores
    depend on the text alone, so repeated rows score the same.
    """
    source = pick(docs, *dict.fromkeys([*keep, "text"]))
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for part in slices(batches, "text"):
            texts = part.column("text")
            found = byte_words(texts)
            p = tagger.marginals(found)
            scores = tagger.score(tagger.evidence(p, found.lengths))
            runs = spans(found, p, texts.cast(pa.large_binary()).fill_null(b"").to_pylist())
            columns = [*(part.column(c) for c in keep), pa.array(scores), pa.array(runs, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "__score", "__spans"])

    return source.mapInArrow(run, ", ".join([*fields, "__score double, __spans array<struct<start:bigint,end:bigint>>"]))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with all their columns."""
    inner, back = shield(docs, "text")
    return tag(inner, model, tuple(inner.columns)).where(F.col("__score") < limit).select(*back)
