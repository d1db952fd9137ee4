"""Vectorised helpers over UTF-8 text held in Arrow buffers.

A batch of texts is one byte array and its offsets, so words, hashes and
shingles come from array operations instead of a Python loop per word.
Words are the contract's ``[^\\x20\\x09-\\x0D]+``; lower-casing is A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = 0x5EED_0F_7E87
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

#: One random 64-bit value per byte value, so that equal sums need equal bytes.
BYTE_VALUES = np.random.default_rng(_SEED).integers(1, 2**64 - 1, 256, dtype=np.uint64)
SHINGLE_WEIGHTS = np.random.default_rng(_SEED + 1).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``data[start:end]``: a polynomial in prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def byte_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each; a longer text stands alone."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (n + 1 entries)."""
    solid = ~IS_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and each text's first word (n + 1 entries)."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    return span_hashes(low, starts, ends), first


def spaced_parts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that together are one text; each but the last ends with white space."""
    at = 0
    while at < len(data):
        to = at + most
        while to < len(data):
            near = np.flatnonzero(IS_SPACE[data[to : to + most]])
            if len(near):
                to += int(near[0]) + 1
                break
            to += most
        to = min(to, len(data))
        yield at, to
        at = to


def long_word_hash(data: np.ndarray, most: int) -> np.ndarray:
    """What ``span_hashes`` gives for one span of any length, made from parts of ``most`` bytes."""
    up, _ = _POWERS.upto(most)
    total = 0
    for at in range(0, len(data), most):
        part = BYTE_VALUES[data[at : at + most]]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 2**64)
    return mix(np.array([(total + len(data)) % 2**64], dtype=np.uint64))


def long_text_words(data: np.ndarray, most: int) -> np.ndarray:
    """``word_hashes`` of one text, holding arrays for about ``most`` bytes at a time."""
    found = []
    for at, to in spaced_parts(data, most):
        part = data[at:to]
        if to - at <= 2 * most:
            found.append(word_hashes(part, np.array([0, to - at]))[0])
            continue
        # White space is far apart here: words before the last one are ordinary, the last is longer than a part.
        solid = len(part) - int(IS_SPACE[part[-1]])
        begin = next((k + 1 for k in range(min(solid, 2 * most) - 1, -1, -1) if IS_SPACE[part[k]]), 0)
        found.append(word_hashes(part[:begin], np.array([0, begin]))[0])
        found.append(long_word_hash(LOWER[part[begin:solid]], most))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_hashes(hashed: np.ndarray, at: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """The hash of the words from each place ``at`` on: ``width`` of them, or fewer where ``stop`` comes first."""
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        here = at + k
        inside = here < stop
        total += np.where(inside, hashed[np.minimum(here, max(len(hashed) - 1, 0))] * SHINGLE_WEIGHTS[k], np.uint64(k + 1))
    return mix(total)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, sorted within it, and their offsets.

    A text of fewer than ``width`` words has its whole sequence as its one
    shingle; one without words has none. A text longer than ``most`` bytes is
    taken part by part.
    """
    if len(offsets) > 2 and (np.diff(offsets) > most).any():
        parts = [shingles(data[a:b], np.array([0, b - a]), width, most) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum([len(x) for x, _ in parts])])
    if len(offsets) == 2 and len(data) > most:
        hashed = long_text_words(data, most)
        n = len(hashed)
        rows = n - width + 1 if n >= width else int(n > 0)
        step = most // 8
        ranges = (np.arange(a, min(a + step, rows)) for a in range(0, rows, step))
        parts = [np.unique(shingle_hashes(hashed, at, np.full(len(at), n), width)) for at in ranges]
        own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
        return own, np.array([0, len(own)])
    hashed, first = word_hashes(data, offsets)
    counts = np.diff(first)
    n_rows = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    text_of = np.repeat(np.arange(len(counts)), n_rows)
    ahead = np.cumsum(n_rows) - n_rows
    at = np.arange(len(text_of)) - ahead[text_of] + first[:-1][text_of]
    total = shingle_hashes(hashed, at, first[1:][text_of], width)
    out, sizes = [], np.zeros(len(counts), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(n_rows)])
    for i in np.flatnonzero(n_rows):
        own = np.unique(total[bounds[i] : bounds[i + 1]])
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])
