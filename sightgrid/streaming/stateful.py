"""Stateful stream operators: camera freshness, edges of presences, persistence.

Each keeps only the little state its key needs (last frame, level, counter) in the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _Edges(StatefulProcessor):
    """Start of a presence, change of its level and its end, by comparison with the previous processed frame.

    ``ord`` is the dense frame ordinal. A frame at or before the last one seen is late and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "ord bigint, level string, ts_ms bigint")

    def _row(self, key, kind, ord_, level):
        return (*key, kind, ord_, level)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        out = []
        data = _sorted(rows, ["ord"])
        for ord_, level, ts in zip(data["ord"], data["level"], data["ts_ms"]):
            ord_, ts = int(ord_), int(ts)
            if last is not None and ord_ <= last[0]:
                continue
            if last is None or ord_ != last[0] + 1:
                if last is not None:
                    out.append(self._row(key, "end", last[0] + 1, last[1]))
                out.append(self._row(key, "start", ord_, level))
            elif level != last[1] and last[1] != "confirmed":
                out.append(self._row(key, "start", ord_, level))
            last = (ord_, level, ts)
        self.state.update(last)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last[2] + self.hold_ms)
        yield _frame(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        out = [] if last is None else [self._row(key, "end", last[0] + 1, last[1])]
        self.state.clear()
        yield _frame(out, self.columns)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], columns: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if kind == "text" else kind)
                         for i, (c, kind) in enumerate(columns)})


def presence_edges(presence: DataFrame, keys: list[str], hold_ms: int = 1000, watermark: str = "10 seconds") -> DataFrame:
    """``start`` and ``end`` rows of presences: live zone alerts (constant level) and object escalation (their level).

    ``presence`` has string ``keys``, ``ord``, ``level`` and ``event_time``; an end without successor is noticed once the
    watermark is ``hold_ms`` past the last sighting.
    """
    use_rocksdb(presence.sparkSession)
    processor = _Edges()
    processor.hold_ms = hold_ms
    processor.columns = [(k, "text") for k in keys] + [("kind", "text"), ("ord", "int64"), ("level", "text")]
    rows = presence.withWatermark("event_time", watermark).withColumn("ts_ms", F.unix_millis("event_time"))
    ddl = ", ".join([f"{k} string" for k in keys] + ["kind string", "ord bigint", "level string"])
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(ddl), outputMode="Append", timeMode="EventTime")


class _Persistence(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "ord bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.state.get() if self.state.exists() else (None, 0)
        out = []
        data = _sorted(rows, ["ord"])
        for ord_, positive in zip(data["ord"], data["positive"]):
            ord_ = int(ord_)
            if last is not None and ord_ <= last:
                continue
            n = (n + 1 if last is None or ord_ == last + 1 else 1) if positive else 0
            last = ord_
            if n >= self.need:
                out.append((*key, ord_, n == self.need))
        self.state.update((last, n))
        yield _frame(out, self.columns)

    def close(self) -> None:
        pass


def live_persistence(flags: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """Frames that complete at least ``n`` consecutive positive ones, per camera."""
    use_rocksdb(flags.sparkSession)
    processor = _Persistence()
    processor.need = n
    processor.columns = [(k, "text") for k in keys] + [("ord", "int64"), ("episode_start", "bool")]
    ddl = ", ".join([f"{k} string" for k in keys] + ["ord bigint", "episode_start boolean"])
    return flags.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(ddl), outputMode="Append", timeMode="None")


class _Freshness(StatefulProcessor):
    """live when a camera sends, stale after 2.2 s of silence, off after 7 s."""

    STALE_MS, OFF_MS = 2200, 7000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["ts_ms"].max()) for part in rows)
        if self.state.exists():
            newest = max(newest, self.state.get()[0])
        self.state.update((newest,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        for wait in (self.STALE_MS, self.OFF_MS):
            self.handle.registerTimer(newest + wait)
        yield _frame([(key[0], "live", newest)], self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0]
        silent = expiredTimerInfo.getExpiryTimeInMs() - last
        state = "off" if silent >= self.OFF_MS else "stale"
        yield _frame([(key[0], state, last)], self.columns)

    def close(self) -> None:
        pass

    columns = [("cam_id", "text"), ("state", "text"), ("last_ms", "int64")]


def camera_freshness(seen: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """State changes of every camera, driven by event time."""
    use_rocksdb(seen.sparkSession)
    rows = seen.withWatermark("event_time", watermark).withColumn("ts_ms", F.unix_millis("event_time"))
    return rows.groupBy("cam_id").transformWithStateInPandas(
        statefulProcessor=_Freshness(), outputStructType=StructType.fromDDL("cam_id string, state string, last_ms bigint"),
        outputMode="Append", timeMode="EventTime")
