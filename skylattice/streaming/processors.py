"""Stateful processors over streams of frames and measurements. They call what the batch operators call,
so that a stream and a table of the same rows give the same result, late rows aside.

Sessions need spark.sql.streaming.stateStore.providerClass set to RocksDB (see `configure`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skylattice import consts as C
from skylattice.operators.network import gate, line_fit
from skylattice.operators.solve import TRACK, follow

GROUPS = "icao24 string, payload_hex string, first_seen_ns long, sensor_ids array<long>, times_ns array<long>"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_time(stream: DataFrame, column: str = "t_ns") -> DataFrame:
    """Adds event_time, for watermarks only: nanoseconds stay in the integer column."""
    return stream.withColumn("event_time", F.timestamp_micros(F.floor(F.col(column) / 1000)))


class Correlator(StatefulProcessor):
    """Anchored groups of one transmission's copies: a group is emitted when a frame, or the watermark,
    is more than the window after its first frame."""

    def __init__(self, window_ns: int = C.CORRELATION_WINDOW_NS, least: int = 2):
        self.window_ns, self.least = window_ns, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "anchor bigint, sensors array<bigint>, times array<bigint>")

    def _emit(self, key) -> list[tuple]:
        anchor, sensors, times = self.group.get()
        self.group.clear()
        rows = sorted(zip(times, sensors))
        return [(key[0], key[1], anchor, [s for _, s in rows], [t for t, _ in rows])] if len(rows) >= self.least else []

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["icao24", "payload_hex", "first_seen_ns", "sensor_ids", "times_ns"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["t_ns", "sensor_id"]).itertuples(index=False):
            t, s = int(r.t_ns), int(r.sensor_id)
            if self.group.exists() and t - self.group.get()[0] > self.window_ns:
                out += self._emit(key)
            if not self.group.exists():
                self.group.update((t, [s], [t]))
                self.handle.registerTimer(t // 1_000_000 + self.window_ns // 1_000_000 + 1)
            else:
                anchor, sensors, times = self.group.get()
                if s not in sensors:
                    self.group.update((min(anchor, t), [*sensors, s], [*times, t]))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.group.exists() and self.group.get()[0] // 1_000_000 + self.window_ns // 1_000_000 < expiredTimerInfo.getExpiryTimeInMs():
            out = self._emit(key)
        yield self._frame(out)

    def close(self) -> None:
        pass


class Tracker(StatefulProcessor):
    """One aircraft's filter; its state is dropped when nothing came for ten minutes of processing time."""

    def __init__(self, ttl_ms: int = 600_000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "x array<double>, p array<double>, outliers int, last_ns bigint, valid_alt double"
        self.state = handle.getValueState("filter", schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        out, after = follow(key[0], pd.concat(list(rows)), tuple(state) if state else None)
        self.state.update(after)
        yield out

    def close(self) -> None:
        pass


SAMPLES = "sensor_i long, sensor_j long, timestamp_ns long, residual_ns double, accepted boolean, sample_count int, slope_ns_per_s double, offset_ns double"


class PairClock(StatefulProcessor):
    """One pair's last samples, gated as they come, and their line; forgotten when none came for two minutes of
    event time."""

    def __init__(self, ttl_ns: int = C.PAIR_EXPIRY_NS):
        self.ttl_ns = ttl_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "times array<bigint>, residuals array<double>, last_ns bigint, timer_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["timestamp_ns", "residual_ns"], kind="stable")
        times, residuals, last, timer = self.kept.get() if self.kept.exists() else ([], [], 0, 0)
        state, out = (np.array(times, dtype=np.int64), np.array(residuals, dtype=float)), []
        for t, e in zip(pdf["timestamp_ns"].tolist(), pdf["residual_ns"].tolist()):
            if last and t - last >= self.ttl_ns:
                state = (np.empty(0, dtype=np.int64), np.empty(0))
            taken, state = gate(np.array([t]), np.array([e]), kept=state)
            last = max(last, t)
            slope, offset = line_fit((state[0] - t) / 1e9, state[1])
            out.append((int(key[0]), int(key[1]), t, e, bool(taken[0]), len(state[0]), slope, offset))
        if timer:
            self.handle.deleteTimer(timer)
        timer = (last + self.ttl_ns) // 1_000_000
        self.handle.registerTimer(timer)
        self.kept.update((state[0].tolist(), state[1].tolist(), last, timer))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SAMPLES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in SAMPLES.split(", ")])

    def close(self) -> None:
        pass


def pair_clocks(stream: DataFrame, delay: str = "1 second", ttl_ns: int = C.PAIR_EXPIRY_NS) -> DataFrame:
    """stream(sensor_i, sensor_j, timestamp_ns, residual_ns), oriented: each sample with whether it was taken, and
    its pair's line after it."""
    timed = event_time(stream.select("sensor_i", "sensor_j", "timestamp_ns", "residual_ns"), "timestamp_ns").withWatermark("event_time", delay)
    return timed.groupBy("sensor_i", "sensor_j").transformWithStateInPandas(PairClock(ttl_ns), SAMPLES, "Append", "EventTime")


def late_rows(query) -> int:
    """Rows that came behind the watermark and were dropped, as far as the query's progress is kept."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def correlate(stream: DataFrame, delay: str = "1 second", **how) -> DataFrame:
    """stream(icao24, payload binary, t_ns, sensor_id): groups as they close."""
    keyed = event_time(stream.filter("icao24 is not null and payload is not null")).withColumn("payload_hex", F.lower(F.hex("payload")))
    keyed = keyed.select("icao24", "payload_hex", "t_ns", "sensor_id", "event_time").withWatermark("event_time", delay)
    return keyed.groupBy("icao24", "payload_hex").transformWithStateInPandas(Correlator(**how), GROUPS, "Append", "EventTime")


def track(stream: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """stream(icao24, t_ns, lat, lon, alt_m, accuracy_m): filtered tracks."""
    wanted = stream.select("icao24", "t_ns", "lat", "lon", "alt_m", "accuracy_m")
    return wanted.groupBy("icao24").transformWithStateInPandas(Tracker(ttl_ms), TRACK, "Append", "ProcessingTime")


def deduplicated(stream: DataFrame, delay: str = "1 second") -> DataFrame:
    """One copy of each sensor's frame within the watermark."""
    timed = event_time(stream).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["sensor_id", "payload"])


def health(stream: DataFrame, every: str = "5 seconds", delay: str = "1 second") -> DataFrame:
    """Frames and sensors seen in each window of event time."""
    timed = event_time(stream).withWatermark("event_time", delay)
    counted = timed.groupBy(F.window("event_time", every)).agg(F.count("*").alias("frame_count"), F.approx_count_distinct("sensor_id").alias("sensors"))
    return counted.select(F.col("window.start").alias("start"), "frame_count", "sensors")
