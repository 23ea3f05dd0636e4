"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import relational as rel
from ..operators import state, sync

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs this state store; it also keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class SlidingLog(StatefulProcessor):
    """The times of accepted calls of a key, at most ``most`` of them.

    Rejected calls are not logged. A timer drops the log of a key that has been quiet for
    a window, so that keys without end do not pile up.
    """

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["t", "id"], kind="stable")
        log = [x[0] for x in self.log.get()]
        out = []
        for t, i in zip(calls["t"].tolist(), calls["id"].tolist(), strict=True):
            log = [x for x in log if t - x < self.window_ms]
            ok = len(log) < self.most
            out.append((key[0], i, ok, 0 if ok else max(1, -(-(self.window_ms - (t - min(log))) // 1000))))
            if ok:
                log.append(t)
        self.log.put([(x,) for x in log])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.window_ms)
        yield pd.DataFrame(out, columns=["key", "id", "accepted", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "accepted": pd.Series(dtype="bool"), "retry_after": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str, ts: str, id_: str, most: int, window_ms: int) -> DataFrame:
    """(key, id, accepted, retry_after) for each call, as they come."""
    use_rocksdb(events.sparkSession)
    calls = events.select(F.col(key).cast("long").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("t"), F.col(id_).cast("long").alias("id"))
    return calls.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SlidingLog(most, window_ms), outputStructType="key long, id long, accepted boolean, retry_after long", outputMode="Append", timeMode="ProcessingTime"
    )


def daily_usage_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Usage by day in append mode; a day comes out once the watermark has passed it."""
    day = F.window("created_at", "1 day")
    marked = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return marked.groupBy(day.alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "calls", "input_tokens")


def first_deliveries(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def apply_changes(changes: DataFrame, read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], columns: list[str]) -> DataStreamWriter:
    """A sink that applies batches of client changes to a table, the last write winning.

    ``write_state`` gets the batch id and must make a repeated batch harmless; applying a
    batch twice gives the same state, as only strictly newer changes win.
    """

    def batch(frame: DataFrame, batch_id: int) -> None:
        newest = rel.latest_per(frame, ["id"], F.desc("updated_at"))
        write_state(sync.last_write_wins(read_state(), newest, columns), batch_id)

    return changes.writeStream.foreachBatch(batch)


def outbox_sweep(ticks: DataFrame, read_words: Callable[[], DataFrame], forward: Callable[[DataFrame, int], None], limit: int = 20) -> DataStreamWriter:
    """Each trigger forwards one bounded batch of what is due; ticks that come meanwhile fold into one."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        now = F.lit(frame.agg(F.max("now")).first()[0])
        forward(state.outbox_due(read_words(), now, limit), batch_id)

    return ticks.writeStream.foreachBatch(batch)


def with_snapshot(events: DataFrame, read_prices: Callable[[], DataFrame], use: Callable[[DataFrame, DataFrame, int], None], least: int = 50) -> DataStreamWriter:
    """A static side read anew for each batch; the one before stays while the new one is too small.

    What stays is the frame, as long as the process lives; ``snapshots.with_versions`` keeps a
    copy of its rows, over restarts too.
    """
    kept: list[DataFrame] = []

    def batch(frame: DataFrame, batch_id: int) -> None:
        new = read_prices()
        if not kept or new.limit(least).count() >= least:
            kept[:] = [new]
        use(frame, kept[0], batch_id)

    return events.writeStream.foreachBatch(batch)
