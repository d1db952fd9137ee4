"""When each entity was seen first and last, kept as state with expiry.

The state of an entity is one row (first and last sighting, their number);
a batch touches the entities that it has rows for and those whose time is up,
and gives out just these. An entity that isn't seen for ``expiry`` of event
time expires; seen again, it goes on with its first sighting. Late rows count
as long as the watermark lets them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([T.StructField("first_ms", T.LongType()), T.StructField("last_ms", T.LongType()), T.StructField("n", T.LongType()), T.StructField("active", T.BooleanType())])


class LastSeen(StatefulProcessor):
    """One state for each entity; a timer at its last sighting plus ``expiry_ms``."""

    def __init__(self, entity_type: T.DataType, expiry_ms: int) -> None:
        self.entity_type, self.expiry_ms = entity_type, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", STATE)

    def _row(self, key, first: int, last: int, n: int, active: bool) -> pd.DataFrame:
        moment = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)
        return pd.DataFrame({"entity": [key[0]], "status": ["ACTIVE" if active else "INACTIVE"], "first_seen_at": [moment(first)], "last_seen_at": [moment(last)], "n": [n]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, n, _ = self.state.get() if self.state.exists() else (None, None, 0, True)
        before = last
        for part in rows:
            low, high = int(part["at_ms"].min()), int(part["at_ms"].max())
            first, last, n = low if first is None else min(first, low), high if last is None else max(last, high), n + len(part)
        if before is not None:
            self.handle.deleteTimer(before + self.expiry_ms)
        due = last + self.expiry_ms
        active = due > timerValues.getCurrentWatermarkInMs()
        if active:
            self.handle.registerTimer(due)
        self.state.update((first, last, n, active))
        yield self._row(key, first, last, n, active)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n, active = self.state.get()
        if active and last + self.expiry_ms <= timerValues.getCurrentWatermarkInMs():
            self.state.update((first, last, n, False))
            yield self._row(key, first, last, n, False)

    def close(self) -> None:
        pass


def last_seen(events: DataFrame, *, entity: str, at: str = "ts", delay: str = "1 day", expiry_days: float = 7) -> DataFrame:
    """entity, status, first_seen_at, last_seen_at and n of the entities that a batch of the stream touches (update mode).

    Times are milliseconds. Rows without an entity or a time don't count.
    Needs the RocksDB state store.
    """
    kind = events.schema[entity].dataType
    rows = events.select(F.col(entity).alias("entity"), F.col(at).cast("timestamp").alias("at")).filter(F.col("entity").isNotNull() & F.col("at").isNotNull())
    rows = rows.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    out = T.StructType([T.StructField("entity", kind), T.StructField("status", T.StringType()), T.StructField("first_seen_at", T.TimestampType()), T.StructField("last_seen_at", T.TimestampType()), T.StructField("n", T.LongType())])
    return rows.groupBy("entity").transformWithStateInPandas(LastSeen(kind, int(expiry_days * 86_400_000)), out, "Update", "EventTime")


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def into(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes what a batch touched under its number; a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def current(touched: DataFrame) -> DataFrame:
    """The latest row of each entity of what ``into`` has written."""
    latest = Window.partitionBy("entity").orderBy(F.col("batch").desc())
    return touched.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r", "batch")
