"""Best-fit packing of token sequences by hierarchical residual rounds.

Each task packs its own pieces best-fit (longest first). Nearly full bins
are done. Two bins only fit together if one of them is at most half full, and
best fit leaves at most one such bin a task: these become the items of the
next, narrower round, with as many of the emptiest other bins, since no more
of those can take one in. A round has at most two items for each task of the
round before. A bin that takes part in a later round moves as a whole, so a
piece's place is the sum of its offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.checkpoints import kept
from .tokens import SLICE_BYTES, encoder
from .vectext import buffers, byte_slices


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``length`` ids; only the first may be shorter than ``capacity``."""
    first = length % capacity
    return [first] * (first > 0) + [capacity] * (length // capacity)


def token_pieces(docs: DataFrame, *, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids (its text's and then ``end_id``).

    Columns: the id, piece (from 0), start, length, ids_crc32 and, with
    ``with_ids``, ids. A null text is empty: its one piece is ``end_id``
    alone. Repeated rows give repeated pieces; other columns are left out.
    """
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at, to in byte_slices(batch.column(1), SLICE_BYTES):
                data, offsets = buffers(batch.column(1).slice(at, to - at))
                ids, first = own.encoded(data, offsets)
                rows: list[tuple] = []
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    start = 0
                    for piece, n in enumerate(cut(len(whole), capacity)):
                        part = whole[start : start + n]
                        rows.append((at + k, piece, start, n, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
                        start += n
                doc, piece, start, length, crc, lists = zip(*rows)
                arrays = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(lists, pa.list_(pa.int64()))] * with_ids, names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(split, schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length in the given order, and the fill of each bin: the fullest bin that has room takes it."""
    mask = 0
    bins_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, offset = [], []
    for n in lengths:
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = bins_of[room].pop()
            if not bins_of[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where.append(b)
        offset.append(fill[b])
        fill[b] += n
        if room > n:
            bins_of[room - n].append(b)
            mask |= 1 << (room - n)
    return where, offset, fill


def _round(items: DataFrame, sizes: str, keys: list[str], capacity: int, level: int) -> DataFrame:
    """Packs each partition; adds _bin, _at (place in the bin) and _fill (of the bin)."""
    schema = T.StructType([*items.schema.fields, T.StructField("_bin", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_fill", T.LongType())])
    names = items.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        # A total order, so that a task that runs again deals out the same bins.
        table = table.sort_by([(sizes, "descending"), *((k, "ascending") for k in keys)]).combine_chunks()
        where, offset, fill = best_fit(table[sizes].to_pylist(), capacity)
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        where = np.asarray(where, dtype=np.int64)
        for name, values in (("_bin", where + base), ("_at", np.asarray(offset, dtype=np.int64)), ("_fill", np.asarray(fill, dtype=np.int64)[where])):
            table = table.append_column(name, pa.array(values))
        yield from table.select([*names, "_bin", "_at", "_fill"]).to_batches(max_chunksize=10_000)

    return items.mapInArrow(pack, schema)


def _movable(open_bins: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The open bins (bin, size) that a round can merge, and their number.

    Those are the bins at most half full and, at most as many, the emptiest
    of the others that have room for the smallest. Any merge of others could
    be done with one of these instead, so leaving them costs no sequence.
    """
    fills = sorted((r["size"], r["count"]) for r in open_bins.groupBy("size").count().collect())
    half = capacity // 2
    small = left = sum(n for size, n in fills if size <= half)
    if not small:
        return open_bins, 0
    whole, last = half, None
    for size, n in fills:
        if half < size <= capacity - fills[0][0] and left:
            if n > left:
                last = (size, left)
                left = 0
                break
            whole, left = size, left - n
    items = open_bins.filter(F.col("size") <= whole)
    if last:
        items = items.unionByName(open_bins.filter(F.col("size") == last[0]).orderBy("bin").limit(last[1]))
    return items, 2 * small - left


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32"), items_per_task: int = 20_000, full: float = 0.99) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to pieces of at most ``capacity``.

    ``key_cols`` and the length order the pieces inside a task; equal pieces
    are dealt to all tasks. Bins filled to ``full`` of the capacity are done
    after each round. Columns of the two names are replaced. An empty table
    gives an empty result; a null length is an error of the caller.
    """
    pieces = kept(pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset"))))
    tasks = -(-pieces.count() // items_per_task)
    # The pieces are read from a checkpoint, so a task that runs again numbers them alike.
    spread = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in key_cols), F.monotonically_increasing_id()), F.lit(1 << 30))
    first = kept(_round(pieces.repartition(max(tasks, 1), spread), length_col, list(key_cols), capacity, 0))
    moved = None
    least = int(capacity * full)
    bins = lambda packed: packed.filter((F.col("_at") == 0) & (F.col("_fill") < least)).select(F.col("_bin").alias("bin"), F.col("_fill").alias("size"))
    open_bins = bins(first)
    level = 0
    while tasks > 1:
        level += 1
        items, n_items = _movable(open_bins, capacity)
        if n_items < 2:
            break
        tasks = max(1, min(tasks // 2, -(-n_items // items_per_task)))
        packed = kept(_round(items.repartition(tasks, F.pmod(F.xxhash64("bin"), F.lit(1 << 30))), "size", ["bin"], capacity, level))
        step = packed.select("bin", F.col("_bin").alias("parent"), F.col("_at").alias("shift"))
        if moved is None:
            moved = step
        else:
            on = step.select(F.col("bin").alias("parent"), F.col("parent").alias("_next"), F.col("shift").alias("_more"))
            onward = moved.join(on, "parent", "left").select("bin", F.coalesce("_next", "parent").alias("parent"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift"))
            # Bins that move for the first time come from ``step``; the other rows of it meet no piece.
            moved = kept(onward.unionByName(step))
        if tasks > 1:
            open_bins = kept(open_bins.join(packed.select("bin"), "bin", "left_anti").unionByName(bins(packed)))
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    if moved is None:
        return first.select(*columns, F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))
    joined = first.join(moved, first["_bin"] == moved["bin"], "left")
    return joined.select(*columns, F.coalesce("parent", "_bin").alias("sequence_id"), (F.col("_at") + F.coalesce("shift", F.lit(0))).alias("offset"))
