"""Streaming forms of frame activity, hysteresis and binned means, over file streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType


def activity(frames: DataFrame, masks: DataFrame, interval: float, start: float = 0.0, late: str = "1 hour") -> DataFrame:
    """run_id, roi, t, value from a stream of run_id, frame_idx, pixels: each frame meets the next one of its run in a join of the stream with itself.

    Frames carry an event time of interval seconds an index (from 1970-01-02 on, as 1970 itself counts as late), so state is kept no longer than frames may be late, and no
    order or single task is asked for. Regions (run_id, roi, px) are a static table, and frames are cut to them before they meet.
    """
    lists = masks.groupBy("run_id", "roi").agg(F.sort_array(F.collect_list("px")).alias("pxs"))
    cut = F.transform("pxs", lambda p: F.element_at("pixels", p + 1).cast("double"))
    rows = frames.join(lists, "run_id").select("run_id", "roi", "frame_idx", F.timestamp_seconds(F.col("frame_idx") * interval + 86_400).alias("at"), cut.alias("own"))
    one = rows.withWatermark("at", late)
    two = rows.select(F.col("run_id").alias("run2"), F.col("roi").alias("roi2"), (F.col("frame_idx") - 1).alias("idx2"), F.col("at").alias("at2"), F.col("own").alias("next")).withWatermark("at2", late)
    near = F.expr(f"run_id = run2 AND roi = roi2 AND frame_idx = idx2 AND at2 >= at AND at2 <= at + interval {2 * interval:f} seconds")
    gaps = F.zip_with("own", "next", lambda a, b: F.abs(b - a))
    return one.join(two, near).select("run_id", "roi", (F.lit(start) + F.col("frame_idx") * interval).alias("t"), F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x).alias("value"))


#: Rows of one frame that a task returns.
SLICE = 100_000


def _numbers(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t, tie, value apart from the frame that they came in."""
    return rows.t.to_numpy(np.float64, copy=True), rows.tie.to_numpy(copy=True), rows.value.to_numpy(np.float64, copy=True)


def _in_order(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts' t, tie, value by t and tie; empties the list."""
    t, tie, value = (np.concatenate([p[k] for p in held]) for k in range(3))
    held.clear()
    at = np.lexsort((tie, t))
    return t[at], tie[at], value[at]


def states_after(v: np.ndarray, mean: float, upper: float, lower: float, bit: int | None) -> np.ndarray:
    """Hysteresis states of values in order, after the state bit or from the start; thresholds in either order."""
    above, below = v > upper, v < lower
    if bit is None:
        bit = 1 if above[0] else 0 if below[0] else int(v[0] > mean)
    sets = above != below
    flips = np.cumsum(above & below)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(v)), -1))
    return np.where(last < 0, bit + flips, above[last] + flips - flips[last]) % 2


def hysteresis(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """run_id, roi, tie, state from a stream of series: a bit is kept for each series, so batches continue each other.

    limits: a static table of run_id, roi, baseline_mean, upper, lower; series without them have no states. Samples of a series
    must arrive in order from batch to batch; a task holds the numbers of one batch of one series (24 bytes a sample and as much again to sort them), which the source's files per trigger bound.
    """
    kind = samples.schema["roi"].dataType.simpleString()
    known = samples.join(limits.select("run_id", "roi", F.col("baseline_mean").cast("double"), F.col("upper").cast("double"), F.col("lower").cast("double")), ["run_id", "roi"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = []
        for rows in batches:
            mean, upper, lower = rows[["baseline_mean", "upper", "lower"]].iloc[0]
            held.append(_numbers(rows))
        t, tie, value = _in_order(held)
        out = states_after(value, mean, upper, lower, state.get[0] if state.exists else None)
        state.update((int(out[-1]),))
        for a in range(0, len(out), SLICE):
            yield pd.DataFrame({"run_id": key[0], "roi": key[1], "tie": tie[a : a + SLICE], "state": out[a : a + SLICE].astype(np.int64)})

    return known.groupBy("run_id", "roi").applyInPandasWithState(step, f"run_id string, roi {kind}, tie long, state long", "bit long", "append", GroupStateTimeout.NoTimeout)


STATE_STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: 1970 itself counts as late, so recordings begin a day later.
EPOCH = 86_400


class _OrderedStates(StatefulProcessor):
    """Holds a series' samples until the watermark has passed them, then gives them their states in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", StructType([StructField("bit", LongType()), *(StructField(c, DoubleType()) for c in ("mean", "upper", "lower", "until"))]))
        # A part holds many samples as bytes, so the store sees a row for each batch, not for each sample.
        self.waiting = handle.getListState("waiting", StructType([StructField(c, BinaryType()) for c in ("t", "tie", "value")]))

    @staticmethod
    def _due(t: float) -> int:
        """The millisecond at which a watermark has passed t."""
        return math.ceil((t + EPOCH) * 1000)

    def _wait(self, t: np.ndarray, tie: np.ndarray, value: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        return [tuple(x[a : a + SLICE].tobytes() for x in (t, tie, value)) for a in range(0, len(t), SLICE)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        for part in rows:
            if not self.now.exists():
                self.now.update((-1, *(float(part[c].iloc[0]) for c in ("baseline_mean", "upper", "lower")), -math.inf))
            if part.tie.hasnans:
                raise ValueError("samples need a tie")
            self.waiting.appendList(self._wait(*_numbers(part)))
            self.handle.registerTimer(max(self._due(float(part.t.min())), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        passed = timerValues.getCurrentWatermarkInMs()
        parts = [tuple(np.frombuffer(x, kind) for x, kind in zip(p, (np.float64, np.int64, np.float64), strict=True)) for p in self.waiting.get()]
        t, tie, value = _in_order(parts)
        n = int(np.searchsorted(np.ceil((t + EPOCH) * 1000), passed, side="right"))
        if n < len(t):
            self.waiting.put(self._wait(t[n:], tie[n:], value[n:]))
            self.handle.registerTimer(self._due(float(t[n])))
        else:
            self.waiting.clear()
        if not n:
            return
        bit, mean, upper, lower, _ = self.now.get()
        states = states_after(value[:n], mean, upper, lower, None if bit < 0 else bit).astype(np.int64)
        self.now.update((int(states[-1]), mean, upper, lower, float(t[n - 1])))
        for a in range(0, n, SLICE):
            own = slice(a, min(a + SLICE, n))
            yield pd.DataFrame({"run_id": key[0], "roi": key[1], "t": t[own], "tie": tie[own], "state": states[own]})

    def close(self) -> None:
        pass


def ordered_hysteresis(samples: DataFrame, limits: DataFrame, late: str = "1 hour") -> DataFrame:
    """run_id, roi, t, tie, state from a stream of series whose samples may come in any order, by event time.

    A series' samples wait in its state until the watermark (late behind the latest sample of all series) has passed them; timers then release them in the
    order of t and tie, so within that time the order of arrival changes nothing. Samples that come later are dropped and counted (late_rows). State is
    the bit, the limits and what waits, which the watermark bounds, not a batch. Samples stay unreleased until something `late` after them has come.
    limits: a static table of run_id, roi, baseline_mean, upper, lower. Runs with RocksDB as the state store (run_to_table(..., rocksdb=True)).
    """
    kind = samples.schema["roi"].dataType.simpleString()
    known = samples.join(limits.select("run_id", "roi", *(F.col(c).cast("double") for c in ("baseline_mean", "upper", "lower"))), ["run_id", "roi"])
    timed = known.withColumn("at", F.timestamp_seconds(F.col("t") + EPOCH)).withWatermark("at", late)
    return timed.groupBy("run_id", "roi").transformWithStateInPandas(statefulProcessor=_OrderedStates(), outputStructType=f"run_id string, roi {kind}, t double, tie long, state long", outputMode="append", timeMode="EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful steps have dropped because they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def binned_means(events: DataFrame, key: str, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Mean value and count of each key in tumbling windows of a stream with a timestamp ts; rows later than the watermark are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col(key)).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "mean", "n")


def run_to_table(stream: DataFrame, path: str, rocksdb: bool = False, dropped: list[int] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the table that it has written; called again with the path, it goes on. dropped: gets the number of rows that came too late."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    if rocksdb:
        spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if rocksdb:
            spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    if dropped is not None:
        dropped.append(late_rows(q))
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
