"""Streams: new log files as they come, and a live feed of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skylog.operators.rebuild import MAX_MICROSECONDS, ROLLOVER


def ingest(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Runs a batch job on every micro-batch and writes its rows under the batch's number, so that a batch run again replaces itself.

    Every log lies in one file, so batches need nothing of each other.
    """

    def each(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


LIMITS = "log_id string, channel string, time long, n long, min double, max double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limits(StatefulProcessor):
    """A log's clock and count as one value, and the limits of each channel as an entry of a map.

    Entries are written for channels whose limits a batch has widened, and for no others.
    """

    def __init__(self, channels: list[str], silent_after_ms: int | None = None) -> None:
        self.channels, self.silent_after_ms = channels, silent_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last long, rolled long, n long")
        self.limits = handle.getMapState("limits", "channel string", "low double, high double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        last, rolled, n = self.clock.get() if self.clock.exists() else (None, 0, 0)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        times = batch["time"].to_numpy()
        steps = times - np.concatenate([times[:1] if last is None else [last], times[:-1]])
        rolled += ROLLOVER * int(((steps < 0) & (steps % ROLLOVER < MAX_MICROSECONDS)).sum())
        last, n = int(times[-1]), n + len(batch)
        self.clock.update((last, rolled, n))
        out = []
        for c in self.channels:
            known = self.limits.getValue((c,)) if self.limits.containsKey((c,)) else (None, None)
            values = batch[c].dropna()
            now = known
            if len(values):
                now = float(values.min()), float(values.max())
                now = now if known[0] is None else (min(known[0], now[0]), max(known[1], now[1]))
            if tuple(now) != tuple(known):
                self.limits.updateValue((c,), now)
            out.append((key[0], c, last + rolled, n, *now))
        if self.silent_after_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_after_ms)
        yield pd.DataFrame(out, columns=["log_id", "channel", "time", "n", "min", "max"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        """A log that has been silent for so long is over: what is kept of it goes."""
        self.clock.clear()
        self.limits.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_limits(feed: DataFrame, channels: list[str], silent_after_ms: int | None = None) -> DataFrame:
    """After each micro-batch, of each log in it: the last unwrapped time, rows so far and each channel's limits so far.

    Rows of a batch are taken in seq order. Null values are passed over; a channel without any has null limits.
    Logs that send nothing for ``silent_after_ms`` are forgotten, if it is given. State is kept by the RocksDB
    store, which the session is set to.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = feed.select("log_id", "seq", "time", *(F.col(c).cast("double").alias(c) for c in channels))
    mode = "none" if silent_after_ms is None else "processingTime"
    return rows.groupBy("log_id").transformWithStateInPandas(Limits(channels, silent_after_ms), LIMITS, "append", mode)
