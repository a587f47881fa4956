"""Accepted or not, for every event: at most so many accepted ones of a user may lie in the trailing window, and refused ones don't count.

decided() is the stream, with the accepted times as list state and a timer that clears them; decided_table() makes the same decisions for a
table. Both go through a user's events by time, ties by event_id, and give one row an event.

Times are whole microseconds. A user's events are cut where nothing comes for a whole window, since nothing is carried over such a gap, so
a table's tasks hold one busy stretch of one user at a time.

Defined results: a null user_id is a user; events without a time or id are left out; an event_id that comes again is another event; an empty table gives no rows.
The stream drops what is older than its watermark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lexispan.sources.shipping import importable

DECISION = "user_id long, event_id long, at long, accepted boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted_in_turn(times: Iterable[int], kept: Iterable[int], most: int, window: int) -> tuple[list[bool], list[int]]:
    """(accepted or not for each of the ascending times, accepted times that still count) after the accepted times `kept`."""
    held, out = deque(kept), []
    for t in times:
        while held and held[0] <= t - window:
            held.popleft()
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, list(held)


def _events(events: DataFrame) -> DataFrame:
    """user_id, event_id, ts and at, its microseconds."""
    ts = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), ts.alias("ts"), F.unix_micros(ts).alias("at")).filter("at is not null and event_id is not null")


class _Decider(StatefulProcessor):
    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        flags, held = accepted_in_turn(new["at"].tolist(), [r[0] for r in self.kept.get()], self.most, self.window)
        self.kept.put([(t,) for t in held]) if held else self.kept.clear()
        if held:
            self.handle.registerTimer((held[-1] + self.window) // 1000 + 1)
        yield pd.DataFrame({"user_id": pd.array([key[0]] * len(new), "Int64"), "event_id": new["event_id"].tolist(), "at": new["at"].tolist(), "accepted": flags})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an older last event leaves what came after it
        held = [r[0] for r in self.kept.get()]
        if held and (held[-1] + self.window) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        yield pd.DataFrame({"user_id": pd.array([], "Int64"), "event_id": pd.array([], "int64"), "at": pd.array([], "int64"), "accepted": pd.array([], "bool")})

    def close(self) -> None:
        pass


def decided(events: DataFrame, most: int = 10, seconds: float = 3600.0, late: str = "1 minute") -> DataFrame:
    """The decisions of a stream of events (user_id, event_id, ts); the session's state store has to be RocksDB, which this sets where none is named."""
    spark = events.sparkSession
    importable(spark)
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = _events(events).withWatermark("ts", late)
    decider = _Decider(most, int(seconds * 1_000_000))
    return timed.groupBy("user_id").transformWithStateInPandas(statefulProcessor=decider, outputStructType=DECISION, outputMode="Append", timeMode="EventTime")


def decided_table(events: DataFrame, most: int = 10, seconds: float = 3600.0) -> DataFrame:
    """The decisions of a table of events (user_id, event_id, ts).

    Stretches are dealt out by user and number and sorted inside their task, which reads them batch by batch: a task holds the
    accepted times of one stretch, and many short stretches cost no more than their events."""
    importable(events.sparkSession)
    window = int(seconds * 1_000_000)
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    apart = F.col("at") - F.lag("at").over(order)
    rows = _events(events).withColumn("fresh", F.coalesce(apart >= window, F.lit(True)).cast("long"))
    rows = rows.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("user_id", "stretch", "event_id", "at")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            users, stretches, times = (batch.column(c).to_pylist() for c in ("user_id", "stretch", "at"))
            flags = []
            for own, run in groupby(zip(users, stretches, times, strict=True), key=lambda r: r[:2]):
                held = held if own == key else []
                some, held = accepted_in_turn((r[2] for r in run), held, most, window)
                flags += some
                key = own
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), batch.column("at"), pa.array(flags, pa.bool_())], ["user_id", "event_id", "at", "accepted"])

    dealt = rows.repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "at", "event_id")
    return dealt.mapInArrow(decide, DECISION)
