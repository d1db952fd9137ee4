"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys fall into a fixed number of cells of the ring, and cells are what the
ring places: each goes clockwise to the first shard that has room for it.
Cells are few (a parameter), so only their sums meet in one task, while rows
are numbered inside their cells. With cells much smaller than a shard the
loads end within a cell of each other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.checkpoints import kept
from .repeated import expanded

RING_BITS = 32


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes."""
    at = lambda s, v: int(hashlib.md5(f"shard:{s}:{v}".encode()).hexdigest()[: RING_BITS // 4], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(replicas))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def place_cells(cells: DataFrame, *, shards: int, n_cells: int, replicas: int = 32, slack: float = 0.0) -> DataFrame:
    """cell, bytes, n and shard for a table of at most ``n_cells`` rows of cell, bytes and n.

    Larger cells choose first. A cell fits a shard that stays within
    (1 + slack) times the mean with it; if none is left, the least loaded
    shard takes it.
    """
    nodes = ring(shards, replicas)
    width = (1 << RING_BITS) // n_cells
    first = F.size(F.filter(_numbers([p for p, _ in nodes]), lambda p: p < F.col("cell") * width))
    around = _numbers([s for _, s in nodes] * 2)
    clockwise = F.array_distinct(F.slice(around, first + 1, len(nodes)))
    listed = cells.select("cell", "bytes", "n", clockwise.alias("choices")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("key"), "cell", "bytes", "n", "choices"))).alias("cells"),
        (F.sum("bytes") * (1.0 + slack) / shards).alias("cap"),
    )

    def step(state: Column, x: Column) -> Column:
        room = F.filter(x["choices"], lambda s: F.get(state["loads"], s.cast("int")) + x["bytes"] <= F.col("cap"))
        chosen = F.coalesce(F.get(room, F.lit(0)), F.array_position(state["loads"], F.array_min(state["loads"])) - 1)
        return _let(
            chosen,
            lambda c: F.struct(
                F.transform(state["loads"], lambda load, i: F.when(i == c, load + x["bytes"]).otherwise(load)).alias("loads"),
                F.concat(state["out"], F.array(c)).alias("out"),
            ),
        )

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<bigint>").alias("out"))
    placed = listed.select("cells", F.aggregate("cells", start, step)["out"].alias("out"))
    return placed.select(F.explode(F.arrays_zip("cells", "out")).alias("z")).select("z.cells.cell", "z.cells.bytes", "z.cells.n", F.col("z.out").cast("int").alias("shard"))


def assign(docs: DataFrame, *, shards: int = 40, n_cells: int = 8192, replicas: int = 32, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ``bytes``, shard and slot.

    Size is the text's UTF-8 bytes and 16 more; a null text has no bytes and
    the checksum 0. The key is the id with the text's checksum, and for a
    repeated row also its place among its equals. So equal texts of several
    ids, rows with null ids and repeated rows all spread over the shards:
    under this law sizes come near equal, and copies needn't stay together.
    Repeated rows are counted and made again, so no task numbers a group, and
    a rerun over other partitions gives the same rows. Further columns are
    left out. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counts = kept(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    rows = expanded(counts, "copies", "copy")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.nullif(F.col("copy"), F.lit(0)).cast("string")))
    cell = F.floor(F.conv(F.substring(key, 1, RING_BITS // 4), 16, 10).cast("long") / ((1 << RING_BITS) // n_cells)).cast("long")
    rows = kept(rows.withColumn("cell", cell))
    sums = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    cells = place_cells(sums, shards=shards, n_cells=n_cells, replicas=replicas, slack=slack)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    # At most n_cells rows, so it is safe to broadcast.
    cells = kept(cells.withColumn("_before", before).select("cell", "shard", "_before"))
    number = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    return (
        rows.withColumn("_number", number)
        .join(F.broadcast(cells), "cell")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_number")).alias("slot"))
    )
