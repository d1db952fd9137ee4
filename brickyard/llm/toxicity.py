"""Toxic spans by a linear-chain conditional random field over words.

Words are runs of letters; a chain is a whole line, however long. The
features of a word are hashes of itself and of its beginnings, so inflected
and compounded words share weights. For the forward and backward passes
chains are laid out in blocks of BLOCK words: a block's product of 2 x 2
transition matrices carries the messages over it, and then all blocks of a
batch run at once, position by position. So the marginals are those of the
whole chain. A document's score comes from them by a small logistic link.

Only documents are labelled, so the labelled words are found first: a word
of a toxic document is toxic if it, or a beginning of it, stands almost only
in toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .classifier import folded, runs
from .vectext import buffers, byte_slices, mix, spaced_parts, span_hashes

BITS = 18
BLOCK = 64
SLICE_BYTES = 1 << 20
#: Lengths in bytes of the beginnings that are features; 0 is the whole word.
PREFIXES = (0, 4, 5, 6, 7, 8)
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    #: One row for each word, one column for each of PREFIXES; 0 where the word is shorter.
    index: np.ndarray
    #: First word of each block, and one more.
    blocks: np.ndarray
    #: Whether a block begins a chain.
    fresh: np.ndarray


def in_blocks(text: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of blocks (and one more), and which of them begin a line of a text."""
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    inside = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    blocks = np.flatnonzero(inside % BLOCK == 0)
    return np.append(blocks, len(text)), inside[blocks] == 0


def word_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and features of all words, and the number of line ends before each."""
    low = folded(data)
    starts, ends = runs(data, offsets, _LETTER) if len(data) else (np.zeros(0, dtype=np.int64),) * 2
    index = np.zeros((len(starts), len(PREFIXES)), dtype=np.int32)
    for k, n in enumerate(PREFIXES):
        long = ends - starts > n if n else np.ones(len(starts), dtype=bool)
        hashed = span_hashes(low, starts[long], starts[long] + n if n else ends[long])
        index[long, k] = (mix(hashed + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int32)
        index[long, k] += index[long, k] == 0
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])[starts] if len(data) else starts
    return starts, ends, index, line


def words(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Words:
    starts, ends, index, line = word_features(data, offsets, bits)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return Words(starts, ends, text, index, *in_blocks(text, line))


def sample_words(texts: pa.Array) -> Words:
    """The words of many texts at once, made slice by slice; places in the bytes are left out."""
    parts, n_texts, n_words = [], 0, 0
    for at, to in byte_slices(texts, SLICE_BYTES):
        w = words(*buffers(texts.slice(at, to - at)))
        parts.append((w.text + n_texts, w.index, w.blocks[:-1] + n_words, w.fresh))
        n_texts, n_words = n_texts + to - at, n_words + len(w.starts)
    none = np.zeros(0, dtype=np.int64)
    text, index, blocks, fresh = (np.concatenate(x) for x in zip(*parts)) if parts else (none, np.zeros((0, len(PREFIXES)), dtype=np.int32), none, none == 0)
    place = np.zeros(len(text), dtype=np.int8)
    return Words(place, place, text, index, np.append(blocks, len(text)), fresh)


def chain_marginals(unary: np.ndarray, blocks: np.ndarray, fresh: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 for each word, and of each pair of labels summed over neighbours (2 x 2)."""
    if not len(unary):
        return np.zeros(0), np.zeros((2, 2))
    size = np.diff(blocks)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    first, longest, begins = blocks[:-1][order], int(size.max()), fresh[order]
    x = np.ones((longest, len(first)))
    alive = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        x[t, : alive[t]] = np.exp(np.clip(unary[first[: alive[t]] + t], -30, 30))
    s = np.exp(step)
    # Only the ratio of the two labels' messages is needed: what comes into a block from the left, and from the right into its last word.
    before, behind = np.full(len(first), 0.5), np.full(len(first), 0.5)
    if not fresh.all():
        over = np.empty((len(first), 2, 2))
        over[:, :, 0] = np.where(begins[:, None], 1.0, s[:, 0])
        over[:, :, 1] = np.where(begins[:, None], 1.0, s[:, 1]) * x[0][:, None]
        for t in range(1, longest):
            k = alive[t]
            over[:k] = over[:k] @ s
            over[:k, :, 1] *= x[t, :k, None]
            over[:k] /= over[:k].sum(axis=(1, 2), keepdims=True)
        rank = np.arange(len(fresh)) - np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        by_rank = np.argsort(rank, kind="stable")
        edges = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
        for r in range(1, len(edges) - 1):
            own = by_rank[edges[r] : edges[r + 1]]
            at, left = place[own], place[own - 1]
            p = before[left]
            one = (1 - p) * over[left, 0, 1] + p * over[left, 1, 1]
            before[at] = one / (one + (1 - p) * over[left, 0, 0] + p * over[left, 1, 0])
        for r in range(len(edges) - 2, 0, -1):
            own = by_rank[edges[r] : edges[r + 1]]
            at, left = place[own], place[own - 1]
            b = behind[at]
            one = over[at, 1, 0] * (1 - b) + over[at, 1, 1] * b
            behind[left] = one / (one + over[at, 0, 0] * (1 - b) + over[at, 0, 1] * b)
    f = np.zeros((longest, len(first)))
    for t in range(longest):
        k = alive[t]
        prev = f[t - 1, :k] if t else before
        one = (prev * s[1, 1] + (1 - prev) * s[0, 1]) * x[t, :k]
        f[t, :k] = one / (one + prev * s[1, 0] + (1 - prev) * s[0, 0])
        if not t:
            f[0, begins] = x[0, begins] / (1 + x[0, begins])
    out, pairs, b = np.zeros(len(unary)), np.zeros((2, 2)), behind
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        own = f[t, :k] * b[:k]
        out[first[:k] + t] = own / (own + (1 - f[t, :k]) * (1 - b[:k]))
        weight, rest = x[t, :k] * b[:k], 1 - b[:k]
        at = slice(None) if t else ~begins
        prev = f[t - 1, :k] if t else before
        joint = np.stack([(1 - prev) * rest * s[0, 0], (1 - prev) * weight * s[0, 1], prev * rest * s[1, 0], prev * weight * s[1, 1]])[:, at]
        pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        one = s[1, 1] * weight + s[1, 0] * rest
        b[:k] = one / (one + s[0, 1] * weight + s[0, 0] * rest)
    return out, pairs


@dataclass
class Crf:
    emit: np.ndarray  # weight of label 1 against 0, for each feature
    bias: float
    step: np.ndarray  # 2 x 2, from label to label

    def unary(self, index: np.ndarray) -> np.ndarray:
        return self.emit[index].sum(axis=1) + self.bias

    def marginals(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        return chain_marginals(self.unary(w.index), w.blocks, w.fresh, self.step)


def labelled_words(w: Words, toxic: np.ndarray, *, bits: int = BITS, least: int = 4, purity: float = 0.9) -> np.ndarray:
    """Label of each word: 1 in toxic texts where a feature stands in at least ``least`` texts, of which ``purity`` are toxic by balanced shares."""
    counts = []
    for label in (1, 0):
        own = toxic[w.text] == label
        n = np.zeros(1 << bits)
        for k in range(len(PREFIXES)):
            pair = np.unique(w.text[own].astype(np.int64) << bits | w.index[own, k])
            n += np.bincount(pair & ((1 << bits) - 1), minlength=1 << bits)
        counts.append(n)
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    share = (counts[0] / n1) / np.maximum(counts[0] / n1 + (counts[1] + 0.3) / n0, 1e-12)
    good = (counts[0] >= least) & (share >= purity)
    good[0] = False
    return ((toxic[w.text] == 1) & good[w.index].any(axis=1)).astype(float)


def fit_crf(w: Words, labels: np.ndarray, *, bits: int = BITS, epochs: int = 20, rate: float = 0.5, l2: float = 1e-6) -> Crf:
    """Conditional log-likelihood by AdaGrad over the whole sample; rare label 1 weighs up to 20 times."""
    crf = Crf(np.zeros(1 << bits), -2.0, np.zeros((2, 2)))
    if not len(labels):
        return crf
    g_emit, g_bias, g_step = np.full(1 << bits, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    inner = np.ones(len(labels), dtype=bool)
    inner[w.blocks[:-1][w.fresh]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1)
    weight = np.where(labels == 1, min(20.0, max(1.0, (labels == 0).sum() / max(labels.sum(), 1) / 10)), 1.0)
    for _ in range(epochs):
        p, pairs = crf.marginals(w)
        delta = (labels - p) * weight
        grad = -l2 * crf.emit
        for k in range(len(PREFIXES)):
            grad += np.bincount(w.index[:, k], weights=delta, minlength=1 << bits)
        grad[0] = 0.0
        g_emit += grad * grad
        crf.emit += rate * grad / np.sqrt(g_emit)
        bias = delta.sum()
        g_bias += bias * bias
        crf.bias += 0.2 * rate * bias / np.sqrt(g_bias)
        step = (seen - pairs) / max(len(at), 1)
        g_step += step * step
        crf.step += 0.1 * rate * step / np.sqrt(g_step)
    return crf


def summary(p: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """What a text's marginals come to: bounded sum, maximum and share of its words."""
    strong = np.where(p >= 0.5, p, 0.0)
    total = np.bincount(text, weights=strong, minlength=n_texts)
    most = np.zeros(n_texts)
    np.maximum.at(most, text, p)
    n = np.bincount(text, minlength=n_texts)
    return np.stack([np.log1p(total), most, np.sqrt(total / np.maximum(n, 1))], axis=1)


def fit_link(x: np.ndarray, y: np.ndarray, *, rounds: int = 50, l2: float = 1e-2) -> np.ndarray:
    """Logistic weights (bias last) by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - l2 * w)
    return w


@dataclass
class Tagger:
    crf: Crf
    link: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.tagged(data, offsets)[0]

    def tagged(self, data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, and start, end, text and marginal of each word."""
        if len(offsets) == 2 and len(data) > 2 * most:
            # One long text: what a word weighs is made part by part, its chains as a whole.
            parts, n_lines = [], 0
            for at, to in spaced_parts(data, most):
                starts, ends, index, line = word_features(data[at:to], np.array([0, to - at]))
                parts.append((starts + at, ends + at, self.crf.unary(index), line + n_lines))
                n_lines += int((data[at:to] == 0x0A).sum())
            starts, ends, unary, line = (np.concatenate(x) for x in zip(*parts))
            text = np.zeros(len(starts), dtype=np.int64)
            p, _ = chain_marginals(unary, *in_blocks(text, line), self.crf.step)
        else:
            w = words(data, offsets)
            starts, ends, text = w.starts, w.ends, w.text
            p, _ = self.crf.marginals(w)
        x = summary(p, text, len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.link[:-1] + self.link[-1], -30, 30))), starts, ends, text, p


def fit(texts: pa.Array, y: np.ndarray) -> Tagger:
    """The field from the first two thirds of the texts, the link from the others, whose words it hasn't seen."""
    cut = len(texts) * 2 // 3
    toxic = y.astype(np.int64)
    w = sample_words(texts.slice(0, cut))
    crf = fit_crf(w, labelled_words(w, toxic[:cut]))
    rest = sample_words(texts.slice(cut))
    x = summary(crf.marginals(rest)[0], rest.text, len(texts) - cut)
    return Tagger(crf, fit_link(x, y[cut:].astype(float)))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))


def tag(docs: DataFrame, tagger: Tagger, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Adds ``score`` and ``spans``, the offending words, to ``docs`` and drops the text; one pass without a shuffle.

    A span is start and end in bytes of the UTF-8 text and the marginal of
    its word, which is ``least`` or more. Null and empty texts have no spans.
    Columns of the two names are replaced; repeated rows stay repeated.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "spans") and c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            for at, to in byte_slices(texts, SLICE_BYTES):
                data, offsets = buffers(texts.slice(at, to - at))
                score, starts, ends, text, p = tagger.tagged(data, offsets)
                hit = np.flatnonzero(p >= least)
                own = text[hit]
                found = pa.StructArray.from_arrays([pa.array(starts[hit] - offsets[own]), pa.array(ends[hit] - offsets[own]), pa.array(p[hit])], names=["start", "end", "marginal"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(to - at + 1)), pa.int32()), found)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(len(kept))), pa.array(score), lists], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").cast("string")).mapInArrow(apply, schema)


def spans(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per offending word: id, start and end in bytes of the UTF-8 text, word and marginal (at least ``least``).

    Texts without such words, null and empty ones have no rows. Repeated
    rows give repeated spans.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{text_col}`").alias("_kept"))
    each = tag(rows, tagger, text_col="_text", least=least).select(F.col(f"`{id_col}`"), F.col("_kept").cast("binary").alias("_bytes"), F.inline("spans"))
    word = F.expr("cast(substring(_bytes, cast(start + 1 as int), cast(`end` - start as int)) as string)")
    return each.select(F.col(f"`{id_col}`"), "start", "end", word.alias("word"), "marginal")
