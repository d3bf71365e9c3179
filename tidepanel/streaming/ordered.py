"""Operators with state per key that see rows in the order of their event time.

Rows wait in state until the watermark has passed them, so what a key gives does not depend on how
rows were dealt over micro-batches, as long as they are no later than the watermark allows. An
event-time timer wakes the key when its next row is due, and again when it has been idle for long
enough; then its state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """The state store that holds several states and timers of a key."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)


#: A waiting row as it is packed in state, and the rows of a packed piece and of an output frame.
ROW, PIECE_ROWS = np.dtype([("at", "<i8"), ("value", "<f8")]), 100_000


def _pack(rows: np.ndarray) -> list[tuple]:
    return [(rows[i:i + PIECE_ROWS].tobytes(),) for i in range(0, len(rows), PIECE_ROWS)]


class InOrder(StatefulProcessor):
    """Feeds the rows (``at`` in microseconds, ``value``) of a key to :meth:`advance` in order of time."""

    #: Columns of what is kept between rows.
    PAST: str

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def advance(self, key, past: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        """(what is kept, output) after rows in order; ``past`` is None for the first ones of a key."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.past = handle.getValueState("past", f"last long, {self.PAST}")

    def _wake(self, ms: int, watermark: int) -> None:
        self.handle.registerTimer(max(ms, watermark + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = np.empty(len(pdf), ROW)
            new["at"], new["value"] = pdf["at"], pdf["value"]
            if len(new):
                self.held.appendList(_pack(new))
                low = int(new["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first // 1000 - 1, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        packed = [np.frombuffer(r[0], ROW) for r in self.held.get()] if self.held.exists() else []
        held = np.concatenate(packed) if packed else np.empty(0, ROW)
        held = held[np.lexsort((held["value"], held["at"]))]
        n = int(np.searchsorted(held["at"], (watermark + 1) * 1000))
        rest = held[n:]
        past = tuple(self.past.get()) if self.past.exists() else None
        if n:
            for i in range(0, n, PIECE_ROWS):
                due = held[i:min(n, i + PIECE_ROWS)]
                kept, out = self.advance(key, past[1:] if past else None, pd.DataFrame({"at": due["at"], "value": due["value"]}))
                past = (int(due["at"][-1]), *kept)
                yield out
            self.past.update(past)
            if len(rest):
                self.held.put(_pack(rest))
            else:
                self.held.clear()
        if len(rest):
            self._wake(int(rest["at"][0]) // 1000 - 1, watermark)
        elif past:
            end = past[0] // 1000 + self.idle_ms
            if end <= watermark:
                self.past.clear()
            else:
                self._wake(end, watermark)

    def close(self) -> None:
        pass


class TrailingPeaks(InOrder):
    PAST = "entry double, peak double"

    def __init__(self, idle_ms: int, drop: float, rise: float):
        super().__init__(idle_ms)
        self.drop, self.rise = drop, rise

    def advance(self, key, past, rows):
        entry, peak = past or (rows["value"].iloc[0],) * 2
        running = rows["value"].cummax().clip(lower=peak)
        down = (running - rows["value"]) / running
        signal = (running > entry * self.rise) & (down >= self.drop)
        return (float(entry), float(running.iloc[-1])), pd.DataFrame({"code": key[0], "at": rows["at"], "close": rows["value"], "peak": running, "drawdown": down, "signal": signal})


class IcMonitor(InOrder):
    PAST = "history array<double>"

    def __init__(self, idle_ms: int, keep: int, alarm: float):
        super().__init__(idle_ms)
        self.keep, self.alarm = keep, alarm

    def advance(self, key, past, rows):
        before = list(past[0]) if past else []
        series = pd.Series(before + rows["value"].tolist())
        roll = series.rolling(self.keep, min_periods=1)
        mean, cut = roll.mean(), len(before)
        ir = mean / (roll.std(ddof=0) + 1e-9)
        low = series.abs().rolling(3, min_periods=3).max() < self.alarm
        kept = [float(x) for x in series.tail(self.keep)]
        return (kept,), pd.DataFrame({"factor": key[0], "at": rows["at"].to_numpy(), "ic": rows["value"].to_numpy(), "ic_mean": mean.to_numpy()[cut:], "ir": ir.to_numpy()[cut:],
                                      "low_ic": low.to_numpy()[cut:]})


def run(rows: DataFrame, key: str, value: str, ts: str, processor: InOrder, output: str, late: str) -> DataFrame:
    """Output of a processor over the rows of every key; its ``at`` comes back as ``ts``."""
    with_store(rows.sparkSession)
    fed = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    fed = fed.select(key, ts, F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("value"))
    out = fed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")
