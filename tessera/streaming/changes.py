"""Streaming twins of the series operators.

Arrival order decides here: a tick is compared with the latest one, by event time, that had arrived before it. An
older tick that comes late is passed on as history and never becomes the standing value.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "user_id BIGINT, event_type STRING, event_id BIGINT, ts TIMESTAMP, value DOUBLE, late BOOLEAN"
MOVE = "user_id BIGINT, event_type STRING, ts TIMESTAMP, value DOUBLE, reference DOUBLE, move DOUBLE"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class ChangeDedupe(StatefulProcessor):
    """Keeps the standing tick of each series; passes on ticks that change it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.standing = handle.getValueState("standing", "at BIGINT, value DOUBLE")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.standing.get() if self.standing.exists() else None
        at, value = (state[0], state[1]) if state else (None, None)
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            late = at is not None and r.us < at
            if late or at is None or r.value != value:
                yield Row(user_id=key[0], event_type=key[1], event_id=r.event_id, ts=r.ts, value=r.value, late=late)
            if not late:
                at, value = r.us, r.value
        if at is not None:
            self.standing.update((at, value))

    def close(self) -> None:
        pass


class Movement(StatefulProcessor):
    """Emits a series' move against its price of `window_s` before, once it reaches a threshold.

    Within the cooldown after an emission, another takes a further move of `again` from the price emitted then. Without a price as old as the window there is no move.
    """

    def __init__(self, threshold: float, window_s: int, cooldown_s: int, again: float):
        self.threshold, self.window, self.cooldown, self.again = threshold, window_s * 1_000_000, cooldown_s * 1_000_000, again

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getListState("ticks", "us BIGINT, event_id BIGINT, value DOUBLE")
        self.emitted = handle.getValueState("emitted", "us BIGINT, value DOUBLE")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ticks = [tuple(t) for t in self.ticks.get()] if self.ticks.exists() else []
        last = tuple(self.emitted.get()) if self.emitted.exists() else None
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            if r.value is None:
                continue
            insort(ticks, (r.us, r.event_id, r.value))
            then = bisect_right(ticks, (r.us - self.window, 2**63, 0.0)) - 1
            if then < 0:
                continue
            del ticks[:then]  # older ones are no reference any more
            reference = ticks[0][2]
            if abs(r.value - reference) < self.threshold:
                continue
            if last and r.us - last[0] < self.cooldown and abs(r.value - last[1]) < self.again:
                continue
            yield Row(user_id=key[0], event_type=key[1], ts=r.ts, value=r.value, reference=reference, move=r.value - reference)
            last = r.us, r.value
        if ticks:
            self.ticks.put(ticks)
        if last:
            self.emitted.update(last)

    def close(self) -> None:
        pass


def tick_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the event files that land in a folder."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def changed_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks that change their series, and late ones, by keyed state."""
    use_rocksdb(ticks.sparkSession)
    timed = ticks.withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("user_id", "event_type").transformWithState(statefulProcessor=ChangeDedupe(), outputStructType=CHANGE, outputMode="Append", timeMode="None")


def moves(ticks: DataFrame, threshold: float = 0.04, window_s: int = 24 * 3600, cooldown_s: int = 6 * 3600, again: float = 0.04) -> DataFrame:
    use_rocksdb(ticks.sparkSession)
    timed = ticks.withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("user_id", "event_type").transformWithState(statefulProcessor=Movement(threshold, window_s, cooldown_s, again), outputStructType=MOVE, outputMode="Append", timeMode="None")


def delivered_once(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops exact re-deliveries of an event within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def window_counts(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, final once the watermark has passed."""
    return ticks.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what has landed, appends it to a Parquet folder and stops; the next call goes on from there."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
