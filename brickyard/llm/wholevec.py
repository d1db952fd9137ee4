"""Vectors of whole numbers: how they are made from floats, and exact arithmetic on them in tasks."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Doubles hold every whole number up to this; components beyond it are set to it.
LARGEST = 2**53
#: Up to this, sums of squared differences of 512 components fit into a long.
PLAIN = 2**26
LONG_MAX = 2**63 - 1


def quantised(vectors: DataFrame, *, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v = floor(scale * x) as longs (x as double) and the columns of ``keep``.

    Rows are left out whose vector is null or holds a null or non-finite
    component, or, with ``dim``, has another length. Null ids stay.
    """
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    whole = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("v"), *(F.col(f"`{c}`") for c in keep))
    rows = rows.filter(F.col("v").isNotNull() & (F.lit(True) if dim is None else F.size("v") == dim) & whole)
    held = lambda c: F.least(F.greatest(c * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return rows.withColumn("v", F.transform("v", lambda c: F.floor(held(c)).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def plain(*arrays: np.ndarray) -> bool:
    """Whether longs are enough for squared distances between these."""
    return all(a.dtype != object and a.shape[-1] <= 512 and (not a.size or (a.min() >= -PLAIN and a.max() <= PLAIN)) for a in arrays)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to ``c`` (one row, or as many); Python integers where ``x`` holds them."""
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff) if diff.dtype != object else (diff * diff).sum(axis=1)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are if longs are enough, else as Python integers."""
    return arrays if plain(*arrays) else tuple(a.astype(object) for a in arrays)


def as_long(values: np.ndarray) -> np.ndarray:
    """Longs; what is larger is the largest long."""
    return values if values.dtype != object else np.array([min(int(v), LONG_MAX) for v in values], dtype=np.int64)


def decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns as Python integers; ``x`` has far fewer than 2**36 rows."""
    return (x if plain(x) else x.astype(object)).sum(axis=0).astype(object)


def long_sum(column: str):
    """Sum of a long column, held within a long; null where all are null."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when(total.isNotNull(), F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)"))).cast("long")
