"""What clients are sent of a session: a message for some of its frames, with all events since the one before, and a last one.

Messages are rows with JSON text; ``sources.push`` sends them to the session's subscriber, where there is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

#: Least milliseconds between two messages of a session.
EMIT_EVERY_MS = 120


class Throttle:
    """The fold that says which frames are sent, as a machine of stretches. Its state is the time of the last frame sent.

    Each frame's successor is the next that would be sent after it: the first that is late enough, stops the session, or has no time. Pointer
    doubling leads every frame to the last one sent of its stretch. A map lists the frames that can be the first sent, by time: those up to the first that
    is late enough for whatever was sent before (``bound`` is the latest time before the stretch).
    """

    start = None
    out = "sent boolean"

    def __init__(self, every_ms: int):
        self.every = every_ms

    def _read(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times, whether they are known, and which frames are sent whatever was before."""
        at = rows.column("at_ms")
        known = at.is_valid().to_numpy()
        fixed = rows.column("stopped").fill_null(False).to_numpy() | ~known
        fixed[1:] |= ~known[:-1]
        return at.fill_null(0).to_numpy().astype(np.int64), known, fixed

    def _successors(self, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """The place of each frame's successor; the number of frames if there is none. Between fixed frames, a clock that is set back is never late enough."""
        n = len(at)
        borders = np.unique(np.concatenate([[0], np.flatnonzero(fixed), [n]]))
        after = np.empty(n, np.int64)
        for begin, end in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            late = np.searchsorted(np.maximum.accumulate(at[begin:end]), at[begin:end] + self.every, "left") + begin
            after[begin:end] = np.maximum(np.minimum(late, end), np.arange(begin + 1, end + 1))
        return after

    def _first(self, at: np.ndarray, fixed: np.ndarray, last: int | None) -> int:
        if last is None or not len(at):
            return 0
        until = int(np.argmax(fixed)) if fixed.any() else len(at)
        return int(np.searchsorted(np.maximum.accumulate(at[:until]), last + self.every, "left")) if until else 0

    def summary(self, rows: pa.Table) -> dict:
        at, known, fixed = self._read(rows)
        after = self._successors(at, fixed)
        n = len(at)
        end = np.where(after < n, after, np.arange(n))
        while not np.array_equal(further := end[end], end):
            end = further
        leaves = lambda f: int(at[end[f]]) if known[end[f]] else None
        until = int(np.argmax(fixed)) if fixed.any() else n
        highest = np.maximum.accumulate(at[:until])
        bound = rows.column("bound")[0].as_py()
        first: list[int] = []
        if until and bound is not None:
            # A first that is late enough for the latest time before is for all, and the list ends with it.
            late = int(np.searchsorted(highest, bound + self.every, "left"))
            head = highest[: late + 1]
            first = [0, *(np.flatnonzero(head[1:] > head[:-1]) + 1).tolist()]
        way = {"none": leaves(0), "by": [[int(at[f]), leaves(f)] for f in first]}
        return way | ({"rest": leaves(until)} if until < n else {})

    def apply(self, way: dict, state: int | None) -> int | None:
        if state is None:
            return way["none"]
        late = next((x for x in way["by"] if x[0] >= state + self.every), None)
        return late[1] if late is not None else way.get("rest", state)

    def then(self, first: dict, second: dict) -> dict:
        way = {"none": self.apply(second, first["none"]), "by": [[a, self.apply(second, e)] for a, e in first["by"]]}
        if "rest" in first:
            return way | {"rest": self.apply(second, first["rest"])}
        most = way["by"][-1][0] if way["by"] else None
        way["by"] += [x for x in second["by"] if most is None or x[0] > most]
        return way | ({"rest": second["rest"]} if "rest" in second else {})

    def replay(self, rows: pa.Table, state: int | None) -> list[pa.Array]:
        at, _, fixed = self._read(rows)
        after = self._successors(at, fixed).tolist()
        sent = np.zeros(len(at), bool)
        place = self._first(at, fixed, state)
        while place < len(at):
            sent[place] = True
            place = after[place]
        return [rows.column("frame_index").combine_chunks(), pa.array(sent)]


def emitted(frames: DataFrame, every_ms: int = EMIT_EVERY_MS, stretch: int = scan.STRETCH, fan: int = scan.FAN) -> DataFrame:
    """Adds whether a frame (session_id, frame_index, at_ms, stopped) is sent: the first, each that comes ``every_ms`` or more after the last sent, and those that stop the session.

    When a frame is sent depends on the one before, so it is a fold over each session's clock; it runs as a scan over stretches of frames. A frame without
    a time is sent, and so is the one behind it. ``frames`` is read once. All its columns go through the scan, so that nothing is joined to them afterwards.
    """
    also = tuple(c for c in frames.columns if c not in ("session_id", "frame_index"))
    sent = scan.scanned_packed(scan.with_stretch(frames, "frame_index", stretch), ["session_id"], "frame_index", Throttle(every_ms), "at_ms", fan, also)
    return sent.select("session_id", "frame_index", *also, "sent")


def frame_messages(frames: DataFrame, boxes: DataFrame, events: DataFrame, every_ms: int = EMIT_EVERY_MS) -> DataFrame:
    """session_id, frame_index, n_events, payload: one message for each frame that is sent, with its visible boxes and all events since the message before.

    Frames hold the session's counters as of then in further columns, which go into the message. Events after the last message aren't sent.
    """
    marked = scan.with_stretch(emitted(frames, every_ms), "frame_index")
    sent = F.when(F.col("sent"), F.col("frame_index"))
    ends = marked.groupBy("session_id", "_stretch").agg(F.min(sent).alias("_later"))
    later = Window.partitionBy("session_id").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_later", F.min("_later").over(later))
    after = Window.partitionBy("session_id", "_stretch").orderBy(F.desc("frame_index")).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.join(ends, ["session_id", "_stretch"]).withColumn("_target", F.coalesce(F.min(sent).over(after), "_later")).drop("_later", "_stretch")
    rest = [c for c in events.columns if c != "session_id"]
    batches = events.join(marked.select("session_id", "frame_index", "_target"), ["session_id", "frame_index"]).where("_target is not null")
    batches = batches.groupBy("session_id", "_target").agg(F.array_sort(F.collect_list(F.struct("frame_index", *[c for c in rest if c != "frame_index"]))).alias("events")).withColumnRenamed("_target", "frame_index")
    shown = boxes.groupBy("session_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct(*[c for c in boxes.columns if c not in ("session_id", "frame_index")]))).alias("detections"))
    rows = marked.where("sent").join(shown, ["session_id", "frame_index"], "left").join(batches, ["session_id", "frame_index"], "left")
    counters = [c for c in frames.columns if c not in ("session_id", "frame_index", "at_ms", "stopped")]
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    payload = F.to_json(F.struct("frame_index", none("detections").alias("detections"), none("events").alias("events"), *counters))
    return rows.select("session_id", "frame_index", F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), payload.alias("payload"))


def final_messages(sessions: DataFrame) -> DataFrame:
    """session_id, payload: the last message of sessions that have ended."""
    from ..plans.sessions import onboard

    ended = sessions.where("status <> 'RUNNING'")
    fields = [
        F.col("status"), F.col("total_alightings").alias("total_exited"), F.lit(0).alias("total_boardings"), "total_alightings", onboard().alias("final_onboard"), "frames_processed",
        (F.col("finished_ms") - F.col("started_ms")).alias("duration_ms"), "error_message", "finish_reason",
    ]
    return ended.select("session_id", F.to_json(F.struct(*fields)).alias("payload"))
