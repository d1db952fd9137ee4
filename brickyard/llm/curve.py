"""Packing along a space-filling curve.

Each document becomes a hashed vector of its tokens, projected to a few
dimensions by a fixed random matrix. The Hilbert key of that point puts
documents of like words next to each other. The documents are laid end to
end in the order of keys, by a range sort and the lengths before each range,
and the line is cut every ``capacity`` tokens; its last part is cut at powers
of two, which need no padding. So only the order costs a shuffle, and it
moves narrow rows: token ids are joined to their place afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.checkpoints import kept
from .tokens import SLICE_BYTES, encoder
from .vectext import buffers, byte_slices, mix

#: Buckets of the hashed vectors, dimensions they are projected to, and bits of each in the key.
BUCKETS, DIMENSIONS, BITS = 4096, 4, 15
#: Ids of a document in one row at most; longer documents go on in further rows.
CHUNK_IDS = 1 << 16
#: Rows that a range holds about.
RANGE_ROWS = 1_000_000
SEED = 12


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits; bits x dimensions are 62 at most.

    The published transposed form: axes are exchanged or inverted from the
    top bit down, Gray coded, and the bits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_PROJECTION = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))
#: Borders of the cells: equal shares of the normal distribution that the coordinates of unlike documents follow.
_CELLS = np.array([NormalDist().inv_cdf(i / 1024) for i in range(1, 1024)])


def hashed(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(SEED)) % np.uint64(BUCKETS)).astype(np.int64)


def coordinates(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Projected hashed vectors of unit length, one row for each text of ids ``first[i]`` to ``first[i + 1]``; zero for a text without ids."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    cell, count = np.unique(text * BUCKETS + hashed(ids), return_counts=True)
    return _projected(cell // BUCKETS, cell % BUCKETS, count, n)


def _projected(text: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(text, weight**2, n))
    point = np.stack([np.bincount(text, weight * _PROJECTION[bucket, k], n) for k in range(DIMENSIONS)], axis=1)
    return point / np.where(norm > 0, norm, 1.0)[:, None]


def long_coordinates(ids: np.ndarray) -> np.ndarray:
    """``coordinates`` of one text, holding arrays for ``CHUNK_IDS`` ids at a time."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(ids), CHUNK_IDS):
        counts += np.bincount(hashed(ids[at : at + CHUNK_IDS]), minlength=BUCKETS)
    bucket = np.flatnonzero(counts)
    return _projected(np.zeros(len(bucket), dtype=np.int64), bucket, counts[bucket], 1)


def keys(points: np.ndarray) -> np.ndarray:
    """Hilbert keys of coordinates: the cell by equal shares, then the place inside it, as the top and low bits."""
    cell = np.searchsorted(_CELLS, points)
    low = np.concatenate([[-8.0], _CELLS])[cell]
    high = np.concatenate([_CELLS, [8.0]])[cell]
    inside = np.clip((points - low) / (high - low), 0, 1 - 2.0**-20)
    return hilbert_keys((cell << (BITS - 10)) + (inside * (1 << (BITS - 10))).astype(np.int64), BITS)


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpacked(raw, n: int) -> np.ndarray:
    """The ``n`` ids of ``packed`` as little-endian unsigned 32-bit numbers."""
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4", copy=False)


def chunks(docs: DataFrame, *, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most CHUNK_IDS ids: the id, row (a number for each document), chunk, key, doc_tokens, n and ids.

    Ids are little-endian unsigned numbers of 16 bits, or of 32 where a row
    has one that needs them (``unpacked`` tells by the length). A document's ids are those of its text and then ``end_id``; a null text is empty.
    """
    schema = T.StructType([
        docs.schema[id_col], T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("key", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at, to in byte_slices(batch.column(1), SLICE_BYTES):
                data, offsets = buffers(batch.column(1).slice(at, to - at))
                ids, first = own.encoded(data, offsets)
                point = long_coordinates(ids) if to - at == 1 else coordinates(ids, first)
                key = keys(point).tolist()
                rows = []
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for c, begin in enumerate(range(0, len(whole), CHUNK_IDS)):
                        part = whole[begin : begin + CHUNK_IDS]
                        rows.append((at + k, c, key[k], len(whole), len(part), packed(part)))
                doc, chunk, key_of, total, n, raw = zip(*rows)
                doc = pa.array(doc)
                arrays = [batch.column(0).take(doc), batch.column(2).take(doc), pa.array(chunk, pa.int32()), pa.array(key_of, pa.int64()), pa.array(total, pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), F.monotonically_increasing_id()).mapInArrow(run, schema)


def places(rows: DataFrame) -> tuple[DataFrame, int]:
    """row, chunk and ``at`` (tokens before it on the line) of each row, and the line's length.

    Rows are sorted by key, row and chunk, so equal keys spread over ranges
    and the chunks of a document follow each other.
    """
    narrow = rows.select("key", "row", "chunk", "n")
    ranges = max(1, -(-narrow.count() // RANGE_ROWS))
    order = ["key", "row", "chunk"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = 0
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            sums = upto + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), batch.column("part"), pa.array(sums - n), pa.array(n)], names=["row", "chunk", "part", "inside", "n"])
            upto = int(sums[-1]) if len(sums) else upto

    ordered = narrow.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ordered = kept(ordered.mapInArrow(add, "row long, chunk int, part int, inside long, n long"))
    # One row for each range.
    totals = kept(ordered.groupBy("part").agg(F.sum("n").alias("total")))
    line = totals.agg(F.sum("total")).first()[0] or 0
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("part", before.alias("before"))
    return ordered.join(F.broadcast(starts), "part").select("row", "chunk", (F.col("before") + F.col("inside")).alias("at")), line


def tail(line: int, capacity: int) -> list[int]:
    """Borders on the line after its last full sequence: what is left as falling powers of two."""
    left = line % capacity
    borders = [line - left]
    for b in reversed(range(left.bit_length())):
        if left >> b & 1:
            borders.append(borders[-1] + (1 << b))
    return borders


def pack(docs: DataFrame, *, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece, and with ``with_ids`` its ids.

    Sequences hold ``capacity`` tokens, but for the last few, whose lengths
    are falling powers of two. A null or empty text is ``end_id`` alone.
    Repeated rows are documents of their own, other columns are left out, and
    an empty table gives an empty result. Pieces end where a sequence does,
    and after each CHUNK_IDS ids of a document.
    """
    rows = kept(chunks(docs, path=path, end_id=end_id, id_col=id_col, text_col=text_col))
    where, line = places(rows)
    borders = np.array(tail(line, capacity), dtype=np.int64)
    full, id_name = int(borders[0]), rows.columns[0]
    fields = [rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, n, chunk = (batch.column(c).to_numpy().astype(np.int64) for c in ("at", "n", "chunk"))
            doc, start, length, crc, seq, offset, lists = [], [], [], [], [], [], []
            for i, raw in enumerate(batch.column("ids")):
                ids, at, end = unpacked(raw.as_buffer(), int(n[i])), int(begin[i]), int(begin[i] + n[i])
                while at < end:
                    if at < full:
                        s, o = divmod(at, capacity)
                        stop = min(end, at - o + capacity)
                    else:
                        k = int(np.searchsorted(borders, at, side="right")) - 1
                        s, o, stop = full // capacity + k, at - int(borders[k]), min(end, int(borders[k + 1]))
                    a, b = at - int(begin[i]), stop - int(begin[i])
                    doc.append(i)
                    start.append(int(chunk[i]) * CHUNK_IDS + a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    seq.append(s)
                    offset.append(o)
                    if with_ids:
                        lists.append(ids[a:b].astype(np.int64).tolist())
                    at = stop
            taken = pa.array(doc)
            arrays = [batch.column(id_name).take(taken), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), batch.column("doc_tokens").take(taken), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(lists, pa.list_(pa.int64()))] * with_ids, names=schema.names)

    placed = rows.join(where, ["row", "chunk"]).select(F.col(f"`{id_name}`"), "chunk", "doc_tokens", "n", "ids", "at")
    return placed.mapInArrow(cut, schema)
