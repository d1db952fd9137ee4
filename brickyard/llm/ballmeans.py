"""Ball k-means over whole-number vectors, exact to the last tie.

A cluster is a ball: its centroid and a radius that no member exceeds. Half
the distance between two centroids separates them, so a ball's *neighbours*
are the centroids nearer than twice its radius. A member nearer to its
centroid than half the way to the first neighbour is in the *stable core* and
stays without any comparison; one between the i-th and the next half distance
is in the i-th *annulus* and is compared with the first i neighbours only.
All tests are on integers, so the result is that of comparing everything.

Centroids and balls (k x dim numbers) go to the tasks with each round; what
comes back are sums, one row for each cluster, component and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.checkpoints import kept, released
from .wholevec import LONG_MAX, as_long, column_sums, decimals, exact, long_sum, matrix, quantised, squared

#: Neighbours of a ball by growing distance, and their squared distances.
Ball = tuple[list[int], list[int]]


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors with the k smallest hashes of seed and id; ties by the vector, null ids don't count."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter(F.col("vec_id").isNotNull()).select(h.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


def balls(centroids: list[list[int]], reach: list[int | None]) -> list[Ball]:
    """The balls' neighbours; ``reach`` bounds each radius from above (None: unbounded)."""
    gap = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in centroids] for x in centroids]
    found = []
    for j, row in enumerate(gap):
        near = sorted((g, k) for k, g in enumerate(row) if k != j and (reach[j] is None or g <= 4 * reach[j] ** 2))
        found.append(([k for _, k in near], [g for g, _ in near]))
    return found


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, by comparing all; ties go to the smaller number."""
    at, best = np.zeros(len(x), dtype=np.int64), squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        closer = d < best
        at[closer], best[closer] = j, d[closer]
    return at, best


def moved(x: np.ndarray, at: np.ndarray, centroids: np.ndarray, of: list[Ball]) -> tuple[np.ndarray, np.ndarray, int]:
    """What ``nearest`` gives, from each row's ball ``at`` of the round before; and how many distances it took."""
    new, best, n = at.copy(), np.zeros(len(x), dtype=x.dtype), 0
    for j in np.unique(at).tolist():
        rows = np.flatnonzero(at == j)
        own = squared(x[rows], centroids[j])
        n += len(rows)
        ids, gaps = of[j]
        limits = np.array(gaps, dtype=object) if x.dtype == object else np.array([min(g, LONG_MAX) for g in gaps], dtype=np.int64)
        annulus = np.searchsorted(limits, own * 4, side="right")
        which, near = np.full(len(rows), j), own
        for t in range(int(annulus.max(initial=0))):
            out = np.flatnonzero(annulus > t)
            d = squared(x[rows[out]], centroids[ids[t]])
            n += len(out)
            better = (d < near[out]) | ((d == near[out]) & (ids[t] < which[out]))
            which[out[better]], near[out[better]] = ids[t], d[better]
        new[rows], best[rows] = which, near
    return new, best, n


def _assigned(rows: DataFrame, centroids: list[list[int]], of: list[Ball] | None) -> DataFrame:
    """vec_id, v, cluster and distance; without balls every centroid is compared."""
    book = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, c = exact(matrix(batch.column("v")), book)
            if of is None:
                at, d = nearest(x, c)
            else:
                at, d, _ = moved(x, batch.column("cluster").to_numpy().astype(np.int64), c, of)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(as_long(d))], names=["vec_id", "v", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, cluster int, distance long")


def _sums(assigned: DataFrame, k: int) -> list:
    """cluster, pos, n, far (largest distance) and total (of the component), k x dim rows at most; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, far = {}, np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x, at, d = matrix(batch.column("v")), batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            for j in np.unique(at).tolist():
                own = at == j
                total[j] = total.get(j, 0) + column_sums(x[own])
                n[j] += int(own.sum())
                far[j] = max(far[j], int(d[own].max()))
        for j, sums in total.items():
            fixed = [pa.array(np.full(len(sums), v)) for v in (j, n[j], far[j])]
            yield pa.RecordBatch.from_arrays([fixed[0], pa.array(np.arange(len(sums))), *fixed[1:], decimals(sums.tolist())], names=["cluster", "pos", "n", "far", "total"])

    parts = assigned.mapInArrow(run, "cluster long, pos long, n long, far long, total decimal(38,0)")
    return parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("total").alias("total")).collect()


def ball_k_means(rows: DataFrame, *, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row of vec_id and v (longs, one length).

    Each round assigns all rows and then replaces each centroid that has
    members by their floored mean; at last all rows are assigned once more.
    Fewer than ``k`` rows with ids give fewer centroids; without any, and for
    an empty table, the result is empty. Repeated rows count as they stand.
    Distances and their sums beyond a long are the largest long.
    """
    spark = rows.sparkSession
    rows = kept(rows.select("vec_id", "v"))
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = kept(_assigned(rows, centroids, None))
    released(rows)
    for _ in range(rounds):
        fresh, reach = [list(c) for c in centroids], [0] * len(centroids)
        for r in _sums(assigned, len(centroids)):
            fresh[r["cluster"]][r["pos"]] = int(r["total"]) // r["n"]
            reach[r["cluster"]] = None if r["far"] == LONG_MAX else isqrt(r["far"]) + 1
        for j, (old, new) in enumerate(zip(centroids, fresh)):
            if reach[j] is not None:
                reach[j] += isqrt(sum((a - b) ** 2 for a, b in zip(old, new))) + 1
        centroids, before = fresh, assigned
        assigned = kept(_assigned(before, centroids, balls(centroids, reach)))
        released(before)
    # One row for each cluster.
    inertia = assigned.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia"))
    by_cluster = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}
    everything = min(sum(by_cluster.values()), LONG_MAX)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(j, n, everything, sha[j]) for j, n in by_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, seed: str = "1", scale: int = 64, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``ball_k_means`` over floor(scale * x) of the vectors with exactly ``dim`` components, none null or non-finite.

    Other columns are left out. Components beyond 2**53 after scaling are set to it.
    """
    return ball_k_means(quantised(vectors, scale=scale, dim=dim, id_col=id_col, vector_col=vector_col), k=k, rounds=rounds, seed=seed)
