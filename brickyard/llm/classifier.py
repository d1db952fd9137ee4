"""Quality classifier: hashed word n-gram logistic regression with FTRL-proximal updates.

A text is a stream of words: runs of letters (lower-cased) and runs of
marks, with a word of its own where a run is all capitals and where a
trigram was seen before in the text. Uni- and bigrams are hashed into a
fixed number of weights. A document's features are relative frequencies, so
its score is one sparse dot product, made of array sums over a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectext import IS_SPACE, buffers, byte_slices, mix, spaced_parts, span_hashes

BITS = 18
SLICE_BYTES = 1 << 20
_CAPITALS, _AGAIN, _PAIR = (np.uint64(x) for x in (0x9D5C3A1F7B2E4681, 0x3C6EF372FE94F82B, 0xD6E8FEB86659FD93))

#: 0 white space, 1 letter, 2 mark
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[IS_SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x30, 0x3A), *range(0x80, 0x100)]] = 1


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the letters U+00C0 to U+00DE."""
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    if len(data) > 1:
        at = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        low[at] += 32
    return low


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal kind above 0; no run reaches over a text's end."""
    of = kind[data]
    change = np.ones(len(data) + 1, dtype=bool)
    change[1:-1] = of[1:] != of[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = of[starts] > 0
    return starts[solid], ends[solid]


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of each word, and whether it is all capitals."""
    starts, ends = runs(data, offsets, _KIND)
    capitals = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    shouted = (ends - starts >= 2) & (capitals[ends] - capitals[starts] == ends - starts)
    return span_hashes(folded(data), starts, ends), np.searchsorted(offsets, starts, side="right") - 1, shouted


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature index and text of each occurrence, and the number of words of each text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(n_texts, dtype=np.int64)
    word, text, shouted = text_words(data, offsets)
    pair = (text[1:] == text[:-1]) if len(text) > 1 else np.zeros(0, dtype=bool)
    two = mix(word[:-1] * _PAIR + word[1:])[pair] if len(word) > 1 else word[:0]
    three = pair[1:] & pair[:-1] if len(pair) > 1 else np.zeros(0, dtype=bool)
    if three.any():
        key = mix((mix(word[:-2] * _PAIR + word[1:-1]) * _PAIR + word[2:]) + text[:-2].astype(np.uint64) * _AGAIN)[three]
        first = np.zeros(len(key), dtype=bool)
        first[np.unique(key, return_index=True)[1]] = True
        again = text[:-2][three][~first]
    else:
        again = text[:0]
    hashed = np.concatenate([word, two, np.full(int(shouted.sum()), _CAPITALS), np.full(len(again), _AGAIN)])
    of = np.concatenate([text, text[:-1][pair] if len(text) > 1 else text[:0], text[shouted], again])
    return (hashed >> np.uint64(64 - bits)).astype(np.int64), of, np.bincount(text, minlength=n_texts)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    scale: float = 24.0
    bits: int = BITS

    def long_total(self, data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights of one text's features, and its words, from parts of about ``most`` bytes that end with white space."""
        of = lambda hashed: self.weights[(hashed >> np.uint64(64 - self.bits)).astype(np.int64)].sum()
        last, total, n, keys = np.zeros(0, dtype=np.uint64), 0.0, 0, []
        for at, to in spaced_parts(data, most):
            word, _, shouted = text_words(data[at:to], np.array([0, to - at]))
            near = np.concatenate([last, word])
            two = mix(near[:-1] * _PAIR + near[1:])
            keys.append(mix(two[:-1] * _PAIR + near[2:]))
            total += of(word) + of(two[max(len(last) - 1, 0) :]) + of(np.full(int(shouted.sum()), _CAPITALS))
            n, last = n + len(word), near[-2:]
        keys = np.concatenate(keys)
        return np.array([total + of(np.full(len(keys) - len(np.unique(keys)), _AGAIN))]), np.array([n])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
            total, n = self.long_total(data, SLICE_BYTES)
        else:
            index, text, n = features(data, offsets, self.bits)
            total = np.bincount(text, weights=self.weights[index], minlength=len(n))
        return 1 / (1 + np.exp(-np.clip(self.bias + self.scale * total / np.maximum(n, 1), -35, 35)))


def fit(texts: pa.Array, y: np.ndarray, *, bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, scale: float = 24.0) -> Model:
    """Follow-the-regularised-leader over the texts in their order, once an epoch; both labels weigh the same in total."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    rows = []
    for at, to in byte_slices(texts, SLICE_BYTES):
        data, offsets = buffers(texts.slice(at, to - at))
        index, text, count = features(data, offsets, bits)
        order = np.argsort(text, kind="stable")
        index, bounds = index[order], np.searchsorted(text[order], np.arange(to - at + 1))
        for k in range(to - at):
            own, times = np.unique(index[bounds[k] : bounds[k + 1]], return_counts=True)
            rows.append((own, times * (scale / max(count[k], 1))))
    for _ in range(epochs):
        for (own, x), label in zip(rows, y):
            zi, ni = z[own], n[own]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = (p - label) * 0.5 / (share if label else 1 - share)
            gx = g * x
            after = ni + gx * gx
            z[own] = zi + gx - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
            n[own] = after
            nb_after = nb + g * g
            zb += g - (np.sqrt(nb_after) - np.sqrt(nb)) / alpha * bias
            nb = nb_after
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w, bias, scale, bits)


def score(docs: DataFrame, scores, *, text_col: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """Adds ``scores(data, offsets)`` of the texts as a double, batch by batch and without a shuffle.

    Null and empty texts are scored as texts without words. A column of that
    name is replaced; repeated rows stay repeated. With ``keep_text`` the
    text (a string) stays, and goes to the workers once.
    """
    kept = [c for c in docs.columns if c.lower() != name and (keep_text or c != text_col)]
    own = [F.col(f"`{c}`") for c in kept]
    sent = own if keep_text else [*own, F.col(f"`{text_col}`").cast("string")]
    at_text = kept.index(text_col) if keep_text else len(kept)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text)
            for at, to in byte_slices(texts, SLICE_BYTES):
                found = scores(*buffers(texts.slice(at, to - at)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(len(kept))), pa.array(found, pa.float64())], names=schema.names)

    return docs.select(*sent).mapInArrow(apply, schema)
