"""Results that several later steps read, kept where every executor can read them."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Folders of kept tables by open scope, innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one of our own only where a local session names none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a table in the shared folder; its lineage ends there.

    A table, and not ``checkpoint()``: it is compressed, later steps read
    only the columns they need, and the optimizer doesn't drag along what it
    has inferred about the plan before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_in = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(table: DataFrame) -> None:
    """Removes a table that ``kept`` has returned and that nothing reads any more; whatever was computed from it must be kept by now."""
    if path := getattr(table, "_kept_in", None):
        _remove(table.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all tables kept inside; results must be written before.

    ``with scope(spark): some_operator(df).write.parquet(path)``
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)
