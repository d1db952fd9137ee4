"""Exact inner-product search with ball trees, one for each shard of the vectors.

Vectors are dealt to shards by hash and queries to blocks; each pair of a
shard and a block is one task's work, which is the whole of a stated query
set against all rows. A tree's nodes are visited by their upper bound
``q . centre + |q| * radius``, for all queries of a block at once; a query is
done with a node whose bound doesn't reach its k-th score so far. That score
starts at what the shards before have given, so all share it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.checkpoints import kept

LEAF = 64
#: Integer inner products below this are exact in double precision.
EXACT = 2.0**53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


@dataclass
class Tree:
    """Nodes in arrays; a leaf holds rows ``order[begin:end]``."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # left child, right is the next one; -1 for a leaf


def build(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Splits at the middle of the direction between two far points until ``leaf`` rows are left; equal rows stay together."""
    order = np.arange(len(x))
    centres, radii, begins, ends, children = [], [], [], [], []

    def add(a: int, b: int) -> None:
        own = x[order[a:b]]
        c = own.mean(axis=0)
        centres.append(c)
        radii.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).max())))
        begins.append(a)
        ends.append(b)
        children.append(-1)

    add(0, len(x))
    at = 0
    while at < len(begins):
        a, b = begins[at], ends[at]
        if b - a > leaf and radii[at] > 0:
            own = x[order[a:b]]
            far = own[((own - centres[at]) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, middle)]
            children[at] = len(begins)
            add(a, a + middle)
            add(a + middle, b)
        at += 1
    return Tree(order, np.array(centres), np.array(radii), np.array(begins), np.array(ends), np.array(children))


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, qs: np.ndarray, q_ids: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and rows (-1: none) of the k best for each query, and how many pairs of leaf and query were scored.

    Nodes are taken by the largest bound of any query that they may still
    serve; a query leaves a node whose bound is below its k-th score so far,
    which starts at ``floors``. Rows of the query's own id don't count, and
    ties go to the smaller id.
    """
    norms = np.sqrt((qs**2).sum(axis=1))
    best = np.full((len(qs), k), -np.inf)
    rows = np.full((len(qs), k), -1)
    kth = floors.copy()
    visited = 0

    def entry(node: int, among: np.ndarray) -> None:
        # A little over the bound covers rounding in centres and radii.
        bound = qs[among] @ tree.centre[node] + norms[among] * tree.radius[node]
        bound += 1e-9 * (np.abs(bound) + norms[among]) + 1e-6
        good = bound >= kth[among]
        if good.any():
            heapq.heappush(queue, (-float(bound[good].max()), node, among[good], bound[good]))

    queue: list = []
    entry(0, np.arange(len(qs)))
    while queue:
        _, node, among, bound = heapq.heappop(queue)
        among = among[bound >= kth[among]]
        if not len(among):
            continue
        child = tree.child[node]
        if child >= 0:
            entry(child, among)
            entry(child + 1, among)
            continue
        visited += len(among)
        own = tree.order[tree.begin[node] : tree.end[node]]
        scores = qs[among] @ x[own].T
        scores[ids[own][None, :] == q_ids[among][:, None]] = -np.inf
        better = (scores >= kth[among][:, None]).any(axis=1) & (scores.max(axis=1) > -np.inf)
        at = among[better]
        all_scores = np.hstack([best[at], scores[better]])
        all_rows = np.hstack([rows[at], np.broadcast_to(own, (len(at), len(own)))])
        order = np.lexsort((ids[all_rows], -all_scores), axis=-1)[:, :k]
        best[at], rows[at] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_rows, order, 1)
        kth[at] = np.maximum(kth[at], best[at, -1])
    rows[best == -np.inf] = -1
    return best, rows, visited


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) as doubles; vectors that are null, empty or hold a null or non-finite component are left out, and so are null ids."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    whole = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for each query.

    Both tables have vec_id and v, whole numbers as doubles. Candidates are
    all rows of another id and the same length, repeated rows as often as
    they stand; a query has fewer than k results where there are fewer
    candidates. Ties go to the smaller vec_id. Equal queries count once.

    Every shard meets every block of queries, as a stated query set against
    all rows does. Shards are searched in waves of one, two, four and so on:
    each wave begins with the k-th scores that all waves before have found.
    """
    vectors = kept(vectors.select("vec_id", "v"))
    queries = kept(queries.select("vec_id", "v").dropDuplicates(["vec_id", "v"]))
    n_shards = max(1, -(-vectors.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    # Rows of one id spread over the shards, however often it stands.
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_shards)).cast("int").alias("shard"))
    asked = queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.size("v").alias("q_dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    nothing = lambda: pd.DataFrame({c: pd.Series(dtype="int64") for c in schema.names})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return nothing()
        x, qs = np.stack(left["v"].to_numpy()), np.stack(right["q"].to_numpy())
        ids, q_ids = left["vec_id"].to_numpy(), right["q_id"].to_numpy()
        most = np.abs(x).max(initial=0.0) * np.abs(qs).max(initial=0.0) * x.shape[1]
        if most < EXACT:
            floors = right["floor"].to_numpy(dtype=float) if "floor" in right else np.full(len(right), -np.inf)
            best, rows, _ = search(build(x), x, ids, qs, q_ids, k, np.where(np.isnan(floors), -np.inf, floors))
            at = np.nonzero(rows >= 0)
            return pd.DataFrame({"query_id": q_ids[at[0]], "vec_id": ids[rows[at]], "score": best[at].astype(np.int64)})
        # Components too large for exact doubles: whole-number arithmetic, held within a long.
        whole, out = [[int(c) for c in v] for v in x], []
        for q, v in zip(q_ids.tolist(), qs):
            v = [int(c) for c in v]
            scored = sorted((-sum(a * b for a, b in zip(v, w)), int(i)) for w, i in zip(whole, ids) if i != q)[:k]
            out += [(q, i, min(max(-s, LONG_MIN), LONG_MAX)) for s, i in scored]
        return pd.DataFrame(out, columns=schema.names).astype("int64") if out else nothing()

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found, first, width = None, 0, 1
    while first < n_shards:
        last = min(first + width, n_shards) - 1
        blocks = asked
        if found is not None:
            floor = found.filter(F.col("rank") == k).select(F.col("query_id").alias("q_id"), F.col("score").cast("double").alias("floor"))
            blocks = asked.join(floor, "q_id", "left")
        wave = dealt.filter(F.col("shard").between(first, last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        shown = blocks.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        rows = wave.groupBy("dim", "shard", "block").cogroup(shown.groupBy("q_dim", "shard", "block")).applyInPandas(run, schema)
        rows = rows if found is None else found.select("query_id", "vec_id", "score").unionByName(rows)
        first, width = last + 1, width * 2
        found = ranked(rows) if first >= n_shards else kept(ranked(rows))
    return found.select("query_id", "rank", "vec_id", "score")
