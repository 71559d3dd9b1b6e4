"""Item states and counts from event streams.

Item states take two streams. The first cuts the log of every micro-batch into stretches and reduces it, in the JVM, to one
small row per item: what the batch does to each start state (``state.event_effects``). The second keeps the state of each item
in the state store and applies those rows. So a hot item costs its worker one row a batch, however many events it had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trendloom.operators.state import event_effects, state_names
from trendloom.schema import IN_FLIGHT_SECONDS
from trendloom.session import settle_batch

STATE = "current_state STRING, transition_num INT, transition_start TIMESTAMP, transition_end TIMESTAMP, completed_timestamp TIMESTAMP"
OUTPUT = f"content_item_id BIGINT, {STATE}"
EFFECTS = (
    "content_item_id BIGINT, starts INT, started TIMESTAMP, "
    "effect ARRAY<STRUCT<state: INT, end_ts: TIMESTAMP, completed_ts: TIMESTAMP>>, batch_id BIGINT"
)
FILES_PER_TRIGGER = 1000


def effect_stream(events: DataFrame, graph: dict[str, list[str]], folder: str, checkpoint: str, initial: str = "undefined") -> StreamingQuery:
    """Reduces every micro-batch of events to its effects, one row per item, under ``folder``; a repeated batch replaces its files.

    The source's ``maxFilesPerTrigger`` bounds a micro-batch.
    """
    spark = events.sparkSession
    times = "array<struct<state: int, end_ts: timestamp, completed_ts: timestamp>>"

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = event_effects(settle_batch(df, spark), graph, initial).withColumns({
            "effect": F.col("effect").cast(times), "started": F.col("started").cast("timestamp"), "batch_id": F.lit(batch_id).cast("bigint"),
        })
        rows.select("content_item_id", "starts", "started", "effect", "batch_id").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_effects(spark: SparkSession, folder: str, max_files: int = FILES_PER_TRIGGER) -> DataFrame:
    """The rows of ``effect_stream`` as a stream."""
    return spark.readStream.schema(EFFECTS).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/batch=*")


class ItemStateProcessor(StatefulProcessor):
    """Keeps the state of one item; events that the graph does not allow were left out of the effects.

    With ``timeouts`` (seconds by state) and ``default`` an item that was started and not brought on within its time is given
    back: a timer that runs out gives a row with ``given_back``. A start that is answered, or a new one, replaces the timer.
    """

    def __init__(self, names: list[str], initial: str, timeouts: dict[str, int] | None = None, default: int = IN_FLIGHT_SECONDS):
        self.names, self.initial, self.timeouts, self.default = names, initial, timeouts, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("item", f"{STATE}, last_batch BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.value.get() if self.value.exists() else (self.initial, 0, None, None, None, -1)
        state, num, start, end, done, last = known
        began = False
        for row in sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["batch_id"]):
            if row["batch_id"] <= last:  # written again after a failure
                continue
            last = int(row["batch_id"])
            then = row["effect"][self.names.index(state)]
            state, end, done = self.names[int(then["state"])], _time(then["end_ts"]) or end, _time(then["completed_ts"]) or done
            num += int(row["starts"])
            if row["starts"]:
                start, began = _time(row["started"]), True
        self.value.update((state, num, start, end, done, last))
        if self.timeouts is not None:
            self._set_timer(state, start, end, began, timerValues)
        yield self._row(key, state, num, start, end, done)

    def _set_timer(self, state, start, end, began, timerValues) -> None:
        waiting = start is not None and (end is None or start > end)
        if began or not waiting:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(_milliseconds(timer))
        if began and waiting:
            seconds = self.timeouts.get(state, self.default)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * seconds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            state, num, start, end, done, _ = self.value.get()
            yield self._row(key, state, num, start, end, done, given_back=True)

    def _row(self, key, state, num, start, end, done, given_back: bool = False) -> pd.DataFrame:
        row = {
            "content_item_id": [key[0]], "current_state": [state], "transition_num": pd.Series([num], dtype="int32"),
            "transition_start": pd.to_datetime([start]), "transition_end": pd.to_datetime([end]),
            "completed_timestamp": pd.to_datetime([done]),
        }
        return pd.DataFrame(row if self.timeouts is None else row | {"given_back": [given_back]})

    def close(self) -> None:
        pass


def _time(value):
    return None if value is None or pd.isna(value) else pd.Timestamp(value).to_pydatetime()


def _milliseconds(timer) -> int:
    return int(timer[0] if isinstance(timer, tuple) else timer)


def reduce_stream(
    effects: DataFrame, graph: dict[str, list[str]], initial: str = "undefined",
    timeouts: dict[str, int] | None = None, default: int = IN_FLIGHT_SECONDS,
) -> DataFrame:
    """Item states that changed in each micro-batch of effects (update mode, RocksDB state store).

    With ``timeouts`` timers of processing time run, and rows say whether an item in flight was given back.
    """
    processor = ItemStateProcessor(state_names(graph, initial), initial, timeouts, default)
    return effects.groupBy("content_item_id").transformWithStateInPandas(
        processor, outputStructType=OUTPUT if timeouts is None else f"{OUTPUT}, given_back BOOLEAN", outputMode="Update",
        timeMode="None" if timeouts is None else "ProcessingTime",
    )


def state_stream(
    events: DataFrame, graph: dict[str, list[str]], effects: str, out: str, checkpoint: str, max_files: int = FILES_PER_TRIGGER,
) -> StreamingQuery:
    """Both streams over all that is there: effects under ``effects``, changed states under ``out``."""
    effect_stream(events, graph, effects, f"{checkpoint}/effects").awaitTermination()
    return to_folder(reduce_stream(read_effects(events.sparkSession, effects, max_files), graph), out, f"{checkpoint}/states", "update")


def windowed_counts(stream: DataFrame, keys: list[str], ts: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows per tumbling window and key of an event-time stream."""
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)
    counted = timed.groupBy(F.window("event_time", width), *keys).agg(F.count(F.lit(1)).alias("num_items"))
    return counted.select(*keys, F.col("window.start").cast("timestamp_ntz").alias("window_start"), "num_items")


def to_folder(stream: DataFrame, folder: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Run a stream over all that is there; the last micro-batch of ``complete`` mode, or every
    micro-batch of other modes, is kept under ``folder`` with its number."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
