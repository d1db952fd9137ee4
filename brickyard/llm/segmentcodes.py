"""Vectors as short codes: one codebook for each part, searched by segment-mean lower bounds.

For a block of s components with sums A and B and residual norms R and Q
(distance from the block's mean), the squared distance is at least
(A - B)**2 / s + (R - Q)**2. The whole part is one block at first, then its
halves, and so on; an entry goes once its bound passes the exact distance of
the best guess. What is left gets exact integer distances, so codes are
those of comparing every entry. Bounds are doubles with a slack wider than
their rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.checkpoints import kept, released
from .wholevec import as_long, column_sums, decimals, exact, long_sum, matrix, quantised, squared

#: Rows that are compared with all entries at once.
BLOCK = 4096
#: Share of entries left from which bounds are computed for all at once.
DENSE = 1 / 16
#: Label sums are broadcast up to this many labels; beyond it Spark chooses, and splits skewed joins.
BROADCAST_LABELS = 100_000


def blocks(width: int) -> list[np.ndarray]:
    """Starts of the blocks on each level, from the whole part to blocks of two or three."""
    levels, n = [], 1
    while width // n >= 2:
        levels.append(np.linspace(0, width, n, endpoint=False).astype(np.int64))
        n *= 2
    return levels or [np.zeros(1, dtype=np.int64)]


def summary(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum / sqrt(size) and residual norm of each row's blocks, as doubles."""
    sizes = np.diff(np.append(starts, x.shape[1]))
    sums = np.add.reduceat(x, starts, axis=1)
    residuals = x * np.repeat(sizes, sizes) - np.repeat(sums, sizes, axis=1)
    norms = np.add.reduceat(residuals.astype(float) ** 2, starts, axis=1)
    return sums.astype(float) / np.sqrt(sizes), np.sqrt(norms) / sizes


@dataclass
class Book:
    """Entries of one part and their summaries by level."""

    entries: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def book(entries: np.ndarray) -> Book:
    return Book(entries, [(starts, *summary(entries, starts)) for starts in blocks(entries.shape[1])])


def encode(x: np.ndarray, own: Book) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (ties: the first), its squared distance, and how many exact distances it took.

    While many entries are left, a level's bounds are one product over all of
    them, and the entry of the least bound gives an exact distance that none
    may pass; with few left they are looked at one by one.
    """
    scale = float(max(np.abs(x).max(initial=0), np.abs(own.entries).max(initial=0)))
    slack = 2.0**-40 * x.shape[1] ** 2 * scale**2
    upper, row, entry, n = np.full(len(x), np.inf), None, None, 0
    for starts, means, norms in own.levels:
        m, r = summary(x, starts)
        if row is None or len(row) > len(x) * len(own.entries) * DENSE:
            # The bound of every entry but for the row's own part.
            bound = np.hstack([m, r]) @ np.hstack([means, norms]).T * -2 + (means**2 + norms**2).sum(axis=1)
            upper = np.minimum(upper, squared(x, own.entries[bound.argmin(axis=1)]).astype(float))
            n += len(x)
            limit = upper * (1 + 2.0**-40) + slack
            row, entry = np.nonzero(bound <= (limit - (m**2 + r**2).sum(axis=1))[:, None])
        else:
            left = ((m[row] - means[entry]) ** 2 + (r[row] - norms[entry]) ** 2).sum(axis=1) <= limit[row]
            row, entry = row[left], entry[left]
    d = squared(x[row], own.entries[entry])
    best = np.minimum.reduceat(d, np.searchsorted(row, np.arange(len(x))))
    hit = np.flatnonzero(d == best[row])
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], best, n + len(row)


def _coded(x: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows, codes, distances) of rows of longs; ``entries`` is parts x entries x width."""
    width = entries.shape[2]
    for p in range(len(entries)):
        own, part = exact(entries[p], x[:, p * width : (p + 1) * width])
        own = book(own)
        for at in range(0, len(x), BLOCK):
            code, d, _ = encode(part[at : at + BLOCK], own)
            yield p, part[at : at + BLOCK], code, d


def _sums(rows: DataFrame, entries: np.ndarray) -> list:
    """part, entry, pos, n and total of all parts that an entry is nearest to; parts x entries x width rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, part, code, _ in _coded(matrix(batch.column(0)), entries):
                order = np.argsort(code, kind="stable")
                found, first = np.unique(code[order], return_index=True)
                for e, own in zip(found.tolist(), np.split(order, first[1:])):
                    total[p, e] = total.get((p, e), 0) + column_sums(part[own])
                    n[p, e] = n.get((p, e), 0) + len(own)
        if total:
            keys = np.array([(p, e, i, n[p, e]) for (p, e), s in total.items() for i in range(len(s))], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i].copy()) for i in range(4)), decimals([v for s in total.values() for v in s.tolist()])], names=["part", "entry", "pos", "n", "total"])

    parts = rows.select("v").mapInArrow(run, "part long, entry long, pos long, n long, total decimal(38,0)")
    return parts.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def train(rows: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks as longs, parts x entries x width, from rows of vec_id and v; None without a row to begin with.

    They begin as the parts of the rows with the smallest ids (ties by the
    vector; null ids don't count; fewer rows, fewer entries). The length of
    the first of these, among those that can be cut, is that of all.
    """
    usable = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)).select("vec_id", "v")
    first = usable.orderBy("vec_id", "v").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["v"])
    usable = usable.filter(F.size("v") == length)
    begin = np.array([r["v"] for r in usable.orderBy("vec_id", "v").limit(entries).collect()], dtype=np.int64)
    books = np.stack(np.split(begin, parts, axis=1))
    for _ in range(rounds):
        fresh = books.copy()
        for r in _sums(rows.filter(F.size("v") == length), books):
            fresh[r["part"], r["entry"], r["pos"]] = int(r["total"]) // r["n"]
        books = fresh
    return books


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds code (two hex digits for each part) and error to rows of v; both are null for vectors of another length than the books'."""
    length = books.shape[0] * books.shape[2]
    names = [c for c in rows.columns if c not in ("v", "code", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column(len(names))
            fits = np.flatnonzero(np.diff(v.offsets.to_numpy()) == length)
            text, error = np.full(n, None, dtype=object), np.full(n, None, dtype=object)
            if len(fits):
                x = matrix(v.take(pa.array(fits)))
                code, total = np.zeros((len(x), len(books)), dtype=np.uint8), [0] * len(books)
                found: dict[int, list] = {}
                for p, _, own, d in _coded(x, books):
                    found.setdefault(p, []).append((own, d))
                for p, got in found.items():
                    code[:, p] = np.concatenate([c for c, _ in got])
                    total[p] = np.concatenate([d for _, d in got])
                digits, k = code.tobytes().hex(), 2 * len(books)
                text[fits] = [digits[i : i + k] for i in range(0, len(digits), k)]
                error[fits] = as_long(sum(t.astype(object) for t in total)).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select(*names, "v").mapInArrow(run, schema)


def decoded(books: np.ndarray, code: str) -> list[int]:
    """The vector that a code stands for."""
    return [int(c) for p, e in enumerate(bytes.fromhex(code)) for c in books[p, e]]


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of finite components.

    A row whose vector is null or holds a null or non-finite component is
    left out. A row whose length isn't the books' has a null code and error;
    ``label_error`` sums the errors of equal labels (nulls together) and is
    null where none has one. Rows with a null id are coded but begin no book.
    Repeated rows stay repeated. Components beyond 2**53 after scaling are
    set to it; errors and sums beyond a long are the largest long. Other
    columns are left out; an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, so that two hex digits name one")
    rows = kept(quantised(vectors, scale=scale, id_col=id_col, vector_col=vector_col, keep=(label_col,)).withColumnRenamed(label_col, "label"))
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        nothing = {"code": "string", "error": "long", "label_error": "long", "codebooks_sha256": "string"}
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = kept(codes(rows, books))
    released(rows)
    sums = coded.groupBy(F.col("label").alias("_l")).agg(long_sum("error").alias("label_error"))
    sums = kept(sums)
    few = sums.count() <= BROADCAST_LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_l")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
