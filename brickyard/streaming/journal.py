"""The change journal: append under gapless numbers, replay after a cursor, follow, and ingest in micro-batches.

The stored journal has two folders: ``rows/batch=N`` with the numbered events
of each batch, and ``commits/batch=N`` with one row, the batch's range of
numbers, which is written last. Readers see committed batches only. A batch
that runs again begins where the batch before it ended, so it gives its
events the same range and replaces what a lost run has left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from brickyard.checkpoints import shared_dir
from brickyard.operators.catalog import positions

TOPICS = ("houses", "jobs", "all")
REPLAY_MOST = 500


def valid(events: DataFrame) -> DataFrame:
    """Events that may be appended: a known topic and a kind that isn't blank."""
    return events.filter(F.col("topic").isin(*TOPICS) & (F.trim(F.coalesce("kind", F.lit(""))) != ""))


def replay(events: DataFrame, cursor: int, limit: int = 100, key: str = "event_id") -> DataFrame:
    """Events after the cursor by id; the limit is held between 1 and 500, a negative cursor is 0."""
    return events.filter(F.col(key) > max(0, cursor)).orderBy(key).limit(min(max(limit, 1), REPLAY_MOST))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """batch, first_id, last_id (first_id - 1 for an empty batch) and n of each committed batch."""
    schema = "first_id long, last_id long, n long, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def high_water(spark: SparkSession, path: str) -> int:
    """The last number given, 0 for an empty journal."""
    return commits(spark, path).agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]


def append(path: str, order: list[Column]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends ``valid`` events under gapless numbers, in ``order`` (its last key must be unique) inside a batch.

    Numbers go on from the last committed batch before this one. A batch that
    is committed is left alone, so a repeated one doubles nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = commits(spark, path)
        if done.filter(F.col("batch") == number).count():
            return
        base = done.filter(F.col("batch") < number).agg(F.coalesce(F.max("last_id"), F.lit(0))).first()[0]
        events = positions(valid(batch), order)
        numbered = events.withColumn("event_id", F.col("position") + base).drop("position")
        numbered.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        n = spark.read.parquet(f"{path}/rows/batch={number}").count()
        spark.createDataFrame([(base + 1, base + n, n)], "first_id long, last_id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")

    return apply


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The committed events of a journal; ``schema`` is that of the events with event_id."""
    done = commits(spark, path).select("batch")
    if not done.count():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    return rows.join(F.broadcast(done), "batch", "left_semi").select(*schema.names)


def polled(spark: SparkSession, path: str, schema: StructType, cursor: int | None = None, *, limit: int = 100, wait: float = 1.0, rounds: int = 60) -> Iterator[list[Row]]:
    """Follows a stored journal from a cursor: at most ``rounds`` looks, each giving up to ``limit`` events in order, or waiting if there are none.

    A look is a filter on numbers, and a limit; batches whose range lies
    before the cursor aren't read (their numbers are in the footers).
    """
    at = start_cursor(cursor, high_water(spark, path))
    for _ in range(rounds):
        found = replay(stored(spark, path, schema), at, limit).collect()
        if found:
            at = found[-1]["event_id"]
            yield found
        else:
            time.sleep(wait)


def start_cursor(requested: int | None, high_water: int) -> int:
    """Where to go on: what was asked for, but never beyond the last event; without a wish, after the last."""
    return high_water if requested is None else min(max(0, requested), high_water)


def follow(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """The journal as a stream of rows; the checkpoint of the query that reads it is its cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)


def sightings(events: DataFrame, *, entity: str = "user_id", at: str = "ts", delay: str = "30 days") -> DataFrame:
    """First and last sighting and their number for each entity and day, as late rows come in (a stream or a table)."""
    rows = events.withWatermark(at, delay) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 day"), entity).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("n"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"


def run_once(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes in all that has come since the last run, batch by batch, and ends.

    ``apply`` gets each batch with its number; writing under that number
    makes a repeated batch replace itself, so restarts lose and double
    nothing.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(path: str, parse: Callable[[DataFrame], DataFrame], key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that parses raw rows, keeps the latest of each key and writes them under the batch's number."""

    def apply(batch: DataFrame, number: int) -> None:
        from brickyard.operators.radius import first_of_each

        rows = first_of_each(parse(batch), key, [F.col(c).desc() for c in order])
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply
