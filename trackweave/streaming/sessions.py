"""Streaming: the tracker as a stateful operator over the same core as in batch, and first-seen clips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import CountConfig, TrackConfig
from ..operators.tracker import ABOUT, LOCK_ROW, TRACK_ROW, SessionCore, restored, seen_of, snapshot, zones_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "session_id string, frame_index int, track_id int, kind string, exits int, total_exits int"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


TRACKS = f"pool string, {TRACK_ROW}"


def _named(kind: T.DataType, value):
    """A value that a state gives back, with structs as dictionaries."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _named(f.dataType, v) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [_named(kind.elementType, v) for v in value]
    return value


def _placed(kind: T.DataType, value):
    """The other way: dictionaries as tuples in the order of the fields."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_placed(f.dataType, value[f.name]) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_placed(kind.elementType, v) for v in value]
    return float(value) if isinstance(kind, T.DoubleType) else value


class SessionTracker(StatefulProcessor):
    """The tracker's core as typed states of its key: a value for zones and counters, lists of tracks and locks, a map of origins, and a timer for sessions that fall idle."""

    def __init__(self, track: TrackConfig, count: CountConfig, idle_ms: int | None):
        self.config, self.idle_ms = (track, count), idle_ms
        self.kinds = {n: T.StructType.fromDDL(k) for n, k in (("about", ABOUT), ("tracks", TRACKS), ("locks", LOCK_ROW))}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", self.kinds["about"])
        self.tracks = handle.getListState("tracks", self.kinds["tracks"])
        self.locks = handle.getListState("locks", self.kinds["locks"])
        self.origins = handle.getMapState("origins", "track_id int", "origin string")

    def _core(self, zones) -> SessionCore:
        if not self.about.exists():
            row = None if zones is None else zones if isinstance(zones, dict) else zones.asDict(recursive=True)
            return SessionCore(zones_of(row) if row else None, row["frame_height"] if row else 0.0, *self.config)
        tracks = [_named(self.kinds["tracks"], t) for t in self.tracks.get()] if self.tracks.exists() else []
        pools = {p: [{k: v for k, v in t.items() if k != "pool"} for t in tracks if t["pool"] == p] for p in ("active", "lost")}
        locks = [_named(self.kinds["locks"], k) for k in self.locks.get()] if self.locks.exists() else []
        origins = {k[0]: v[0] for k, v in self.origins.iterator()} if self.origins.exists() else {}
        return restored({"about": _named(self.kinds["about"], self.about.get()), "locks": locks, "origins": origins, **pools}, *self.config)

    def _keep(self, core: SessionCore, known: dict[int, str]) -> None:
        row = snapshot(core)
        self.about.update(_placed(self.kinds["about"], row["about"]))
        lists = (self.tracks, "tracks", [t | {"pool": p} for p in ("active", "lost") for t in row[p]]), (self.locks, "locks", row["locks"])
        for state, name, found in lists:
            if found:
                state.put([_placed(self.kinds[name], x) for x in found])
            else:
                state.clear()
        for track_id, origin in row["origins"].items():
            if known.get(track_id) != origin:
                self.origins.updateValue((track_id,), (origin,))

    def _forget(self) -> None:
        for state in (self.about, self.tracks, self.locks, self.origins):
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        core = self._core(frames["zones"].iloc[0])
        known, out = dict(core.origins), []
        for r in frames.itertuples():
            out += core.frame(int(r.frame_index), [seen_of(dict(d) if not hasattr(d, "asDict") else d.asDict()) for d in r.detections])
        for timer in list(self.handle.listTimers()) if self.idle_ms is not None else []:
            self.handle.deleteTimer(timer)
        if frames["ended"].any():
            self._forget()
        else:
            self._keep(core, known)
            if self.idle_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        found = pd.DataFrame(out, columns=COLUMNS[1:])
        found.insert(0, "session_id", key[0])
        yield found

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def live_exits(frames: DataFrame, zones: DataFrame, track: TrackConfig, count: CountConfig, idle_ms: int | None = 60_000) -> DataFrame:
    """Exit events from a stream of frames: session_id, frame_index, ended, detections (an array, empty frames included).

    A micro-batch may hold several frames of a session; they are taken by index. State goes when a row has ``ended`` or the session is
    idle for ``idle_ms``; without that only at the end, as bounded runs need. ``zones``, a static
    table of one row for each session, are joined to the frames, and each session keeps its own. The session needs the RocksDB state store (``ROCKS``), which this sets.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    about = F.struct(*[F.col(c) for c in zones.columns if c != "session_id"]).alias("zones")
    frames = frames.join(zones.select("session_id", about), "session_id", "left")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return frames.groupBy("session_id").transformWithStateInPandas(SessionTracker(track, count, idle_ms), OUT, "Append", mode)


def first_seen(clips: DataFrame, results: DataFrame, delay: str = "1 day") -> DataFrame:
    """Clips whose content is new within the watermark and not in stored results."""
    fresh = clips.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    return fresh.join(results.selectExpr("file_sha256 as sha256").where("sha256 is not null"), "sha256", "left_anti")
