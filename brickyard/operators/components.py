"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.checkpoints import kept

#: What is left of a graph is solved in one task once it has no more edges than this (some 10 MB).
FEW_EDGES = 100_000


def _solved(edges: DataFrame) -> DataFrame:
    """v and to (one vertex of the component) of a few edges."""
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("v", kind), T.StructField("to", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent[root(a)] = root(b)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), of), pa.array([root(x) for x in parent], of)], names=["v", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame, few: int | None = None) -> DataFrame:
    """v and root (the smallest vertex reachable) for each vertex of edges a, b.

    In each round every vertex is replaced by the first of itself and its
    neighbours in a seeded order of hashes, and edges inside one vertex go.
    The graph shrinks by a share each round, so all rounds together handle
    some multiple of the edges once. The last ``few`` edges (FEW_EDGES) are
    solved at once. Self-loops and nulls don't count.
    """
    few = FEW_EDGES if few is None else few
    edges = kept(edges.select("a", "b").filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while edges.count() > few:
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("v")).agg(F.min(order("b")).alias("n"))
        maps.append(kept(first.select("v", F.least(order("v"), "n")["x"].alias("to"))))
        of = lambda c: maps[-1].select(F.col("v").alias(c), F.col("to").alias(f"to_{c}"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").filter(F.col("to_a") != F.col("to_b"))
        edges = kept(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    labels = _solved(edges)
    for m in reversed(maps):
        labels = m.join(labels.select(F.col("v").alias("to"), F.col("to").alias("_on")), "to", "left").select("v", F.coalesce("_on", "to").alias("to"))
    labels = kept(labels)
    least = labels.groupBy("to").agg(F.min("v").alias("root"))
    return kept(labels.join(least, "to").select("v", "root"))
