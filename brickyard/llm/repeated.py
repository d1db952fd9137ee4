"""Equal rows as one row and a count, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies that one task makes of one row.
CHUNK = 4096


def expanded(counts: DataFrame, times: str, copy: str) -> DataFrame:
    """Each row as often as ``times`` says, with its place ``copy`` (from 0) among its copies; rows of null or 0 times go.

    Rows of more than CHUNK copies are dealt out chunk by chunk.
    """
    columns = [F.col(f"`{c}`") for c in counts.columns if c not in (times, copy)]
    upto = lambda first, last: F.explode(F.sequence(first, last)).alias(copy)
    n = F.col(times).cast("long")
    small = counts.filter((n > 0) & (n <= CHUNK)).select(*columns, upto(F.lit(0).cast("long"), n - 1))
    large = counts.filter(n > CHUNK).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK))))
    large = large.repartition(*columns, F.col(copy))
    return small.unionByName(large.select(*columns, upto(F.col(copy) * CHUNK, F.least((F.col(copy) + 1) * CHUNK, n) - 1)))
