"""Smart stop: when a clip's analysis may end early, from door and street signatures.

Signature arithmetic, activity times and run lengths are windows over stretches of frames, into each of which a table of one row a stretch carries what the stretches before it leave: their last frame, their last
activity, and the seconds that a flag has held. Only the candidate, which can be cancelled, is a fold, and that runs as a scan. So no task holds a session.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import StopConfig
from ..lineage import cut
from . import scan

#: Reasons to stop early, those that come first win.
REASONS = ("MAX_DURATION", "DOOR_CLOSED", "INACTIVITY_AND_MOVEMENT")


STRETCH_KEYS = ["session_id", "_stretch"]


def _stretch():
    return Window.partitionBy(*STRETCH_KEYS).orderBy("frame_index")


def _so_far():
    return _stretch().rowsBetween(Window.unboundedPreceding, 0)


def _stretches(*keys: str):
    """The stretches of a session in order; of tables that have a row for each."""
    return Window.partitionBy("session_id", *keys).orderBy("_stretch")


def _carried(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds to rows what ``ends`` has for their stretch; null sessions are a session, too."""
    held = cut(ends, "stretch-ends").withColumnsRenamed({k: f"_k{k}" for k in STRETCH_KEYS})
    same = [rows[k].eqNullSafe(held[f"_k{k}"]) for k in STRETCH_KEYS]
    return rows.join(held, same[0] & same[1], "left").drop(*[f"_k{k}" for k in STRETCH_KEYS])


def normalised(signature: Column) -> Column:
    """A signature less its mean, over its deviation plus a floor; null cells stay null."""
    valid = F.filter(signature, lambda x: x.isNotNull())
    n = F.size(valid)
    mean = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(valid, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n) + 0.08
    return F.when(n > 0, F.transform(signature, lambda x: (x - mean) / spread)).otherwise(signature)


def difference(a: Column, b: Column) -> Column:
    """Half the mean absolute difference over cells that both have, held within 0 and 1; 0 without any or for other lengths."""
    gaps = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda x: x.isNotNull())
    mean = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(gaps) / 2
    return F.when((F.size(a) == F.size(b)) & (F.size(gaps) > 0), F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def timed(frames: DataFrame) -> DataFrame:
    """Adds video seconds; frame rates that aren't above 0 count as 25."""
    fps = F.when((F.col("fps") > 0) & (F.col("fps") < float("inf")), F.col("fps")).otherwise(25.0)
    return frames.withColumn("_fps", fps).withColumn("video_s", F.col("frame_index") / F.col("_fps"))


def with_past(rows: DataFrame) -> DataFrame:
    """Adds to timed rows with stretches the seconds since the frame before, whether anyone was active at all so far, and seconds since, and door and scene motion: differences to the frame before."""
    frame, active = F.struct("frame_index", "door", "street"), F.when(F.col("active"), F.col("video_s"))
    ends = rows.groupBy(*STRETCH_KEYS).agg(F.max_by(frame, "frame_index").alias("_frame"), F.max_by(active, F.when(active.isNotNull(), F.col("frame_index"))).alias("_active"))
    before = _stretches().rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*STRETCH_KEYS, F.lag("_frame").over(_stretches()).alias("_frame"), F.last("_active", ignorenulls=True).over(before).alias("_active"))
    rows = _carried(rows, ends)
    rows = rows.withColumn("_before", F.coalesce(F.lag(frame).over(_stretch()), F.col("_frame"))).withColumn("_last", F.coalesce(F.last(active, ignorenulls=True).over(_so_far()), F.col("_active")))
    step = F.greatest(F.col("frame_index") - F.col("_before.frame_index"), F.lit(0)) / F.col("_fps")
    rows = rows.withColumn("delta_s", F.when(F.col("_before").isNotNull(), F.coalesce(step, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("activity_seen", F.col("_last").isNotNull()).withColumn("idle_s", F.coalesce(F.greatest(F.col("video_s") - F.col("_last"), F.lit(0.0)), F.lit(0.0)))
    for kind, out in (("door", "door_motion"), ("street", "scene_motion")):
        rows = rows.withColumn(out, F.when(F.col(f"_before.{kind}").isNull(), 0.0).otherwise(difference(F.col(kind), F.col(f"_before.{kind}"))))
    return rows.drop("_fps", "_frame", "_active", "_before", "_last")


def seconds_in_row(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Adds for each flag, under its name in ``flags``, the seconds for which it has held without a break; a break resets them."""
    for k, (flag, out) in enumerate(flags.items()):
        rows = rows.withColumn(f"_breaks{k}", F.sum((~F.col(flag)).cast("int")).over(_so_far()))
        own = Window.partitionBy(*STRETCH_KEYS, f"_breaks{k}").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(out, F.when(F.col(flag), F.sum(F.when(F.col(flag), F.col("delta_s")).otherwise(0.0)).over(own)).otherwise(0.0))
    ends = rows.groupBy(*STRETCH_KEYS).agg(*[c for k, out in enumerate(flags.values()) for c in (F.max_by(out, "frame_index").alias(f"_held{k}"), F.coalesce(F.max(f"_breaks{k}") > 0, F.lit(False)).alias(f"_broken{k}"))])
    for k in range(len(flags)):
        # What a stretch leaves goes on through the unbroken ones behind it.
        ends = ends.withColumn(f"_run{k}", F.sum(F.col(f"_broken{k}").cast("int")).over(_stretches()))
        ends = ends.withColumn(f"_left{k}", F.sum(f"_held{k}").over(_stretches(f"_run{k}")))
    rows = _carried(rows, ends.select(*STRETCH_KEYS, *[F.lag(f"_left{k}").over(_stretches()).alias(f"_left{k}") for k in range(len(flags))]))
    for k, (flag, out) in enumerate(flags.items()):
        goes_on = F.col(flag) & (F.coalesce(F.col(f"_breaks{k}"), F.lit(0)) == 0)
        rows = rows.withColumn(out, F.when(goes_on, F.col(out) + F.coalesce(F.col(f"_left{k}"), F.lit(0.0))).otherwise(F.col(out))).drop(f"_breaks{k}", f"_left{k}")
    return rows


def open_reference(rows: DataFrame, cfg: StopConfig) -> DataFrame:
    """The open door's signature of each session: the mean of the first quiet frames; and the frame that completes it."""
    quiet = rows.where(~F.col("active") & (F.col("door_motion") <= cfg.stable_motion) & (F.col("activity_seen") | F.lit(not cfg.need_activity)))
    few = lambda df, w: df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(cfg.calibration_samples, 1))
    first = cut(few(few(quiet, _stretch()), Window.partitionBy("session_id").orderBy("frame_index")).select("session_id", "frame_index", "door"), "quiet-frames")
    cells = first.select("session_id", "frame_index", F.posexplode("door").alias("cell", "v"))
    means = cells.groupBy("session_id", "cell").agg(F.avg("v").alias("v"))
    whole = means.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("_c")).select("session_id", F.transform("_c", lambda c: c["v"]).alias("reference"))
    done = first.groupBy("session_id").agg(F.count(F.lit(1)).alias("_k"), F.max("frame_index").alias("ready_frame")).where(F.col("_k") >= max(cfg.calibration_samples, 1))
    return whole.join(done.select("session_id", "ready_frame"), "session_id")


def door_confidence(state: Column, gap: Column, cfg: StopConfig) -> Column:
    open_max, closed_min = max(cfg.open_max, 0.001), max(cfg.closed_min, 0.001)
    hold = lambda v, low: F.least(F.greatest(v, F.lit(low)), F.lit(1.0))
    return F.when(state == "OPEN", hold(1 - gap / open_max, 0.0)).when(state == "CLOSED", hold(0.5 + (gap - closed_min) / closed_min, 0.5)).otherwise(0.0)


def door_states(frames: DataFrame, cfg: StopConfig, stretch: int = scan.STRETCH) -> DataFrame:
    """Frames (session_id, frame_index, fps, door, street, active) with all that the candidate needs. Signatures are normalised here."""
    even = frames.withColumns({c: normalised(F.col(c)) for c in ("door", "street")})
    rows = cut(with_past(cut(scan.with_stretch(timed(even), "frame_index", stretch), "even-frames")), "past-frames")
    rows = rows.join(cut(open_reference(rows, cfg), "open-doors"), "session_id", "left")
    known = F.col("ready_frame").isNotNull() & (F.col("frame_index") >= F.col("ready_frame"))
    rows = rows.withColumn("gap", F.when(known, difference(F.col("door"), F.col("reference"))).otherwise(0.0))
    state = (
        F.when(~known, "CALIBRATING")
        .when(F.col("active") | (F.col("door_motion") > cfg.stable_motion), "UNKNOWN")
        .when(F.col("gap") <= cfg.open_max, "OPEN")
        .when(F.col("gap") >= cfg.closed_min, "CLOSED")
        .otherwise("UNKNOWN")
    )
    rows = rows.withColumn("door_state", state).withColumn("door_confidence", door_confidence(F.col("door_state"), F.col("gap"), cfg))
    rows = rows.withColumn("_closed", F.col("door_state") == "CLOSED").withColumn("_moving", F.col("scene_motion") >= cfg.scene_motion).drop("reference")
    rows = seconds_in_row(rows, {"_closed": "closed_s", "_moving": "moving_s"})
    return rows.withColumn("vehicle_moving", F.col("moving_s") >= max(cfg.vehicle_confirm_s, 0.0)).drop("_closed", "_moving", "_stretch")


@dataclass
class Candidate:
    """The reason to stop, if any, since when, and whether it has held long enough."""

    cfg: StopConfig
    reason: str | None = None
    since: float = 0.0
    stopped: bool = False

    def step(self, r: dict) -> None:
        cfg, now = self.cfg, r["video_s"]
        if self.stopped:
            return
        if self.reason is not None:
            broken = {"DOOR_CLOSED": r["active"] or r["door_state"] != "CLOSED", "INACTIVITY_AND_MOVEMENT": r["active"] or not r["vehicle_moving"]}
            if broken.get(self.reason, False):
                self.reason = None
            elif now - self.since >= max(cfg.post_roll_s, 0.0):
                self.stopped = True
            return
        if now < max(cfg.min_seconds, 0.0):
            return
        if cfg.max_seconds > 0 and now >= cfg.max_seconds:
            self.reason = "MAX_DURATION"
        elif r["door_state"] == "CLOSED" and r["closed_s"] >= max(cfg.closed_confirm_s, 0.0) and r["idle_s"] >= max(cfg.clear_s, 0.0):
            self.reason = "DOOR_CLOSED"
        elif cfg.motion_fallback and r["activity_seen"] and r["idle_s"] >= max(cfg.inactivity_s, 0.0) and r["vehicle_moving"]:
            self.reason = "INACTIVITY_AND_MOVEMENT"
        if self.reason is not None:
            self.since, self.stopped = now, cfg.post_roll_s <= 0


def until_stop(frames: DataFrame, points: DataFrame) -> DataFrame:
    """Frames up to the one at which analysis stops, which is the last; all frames of sessions that don't stop."""
    ends = points.where("stopped").groupBy("session_id").agg(F.min("frame_index").alias("_end"))
    return frames.join(ends, "session_id", "left").where(F.col("_end").isNull() | (F.col("frame_index") <= F.col("_end"))).drop("_end")


class StopMachine:
    """The candidate as a machine of stretches. Its state is "none", or a reason and since when, or that the session has stopped.

    A stretch's map says what becomes of a session without a candidate, and of one that comes in with each reason: the latest time before the candidate breaks, if it does,
    and what becomes of the session behind that frame. Whether the candidate has held long enough by then follows from its own time.
    """

    start = ["none"]
    out = "door_state string, phase string, reason string, stopped boolean"

    def __init__(self, cfg: StopConfig):
        self.cfg, self.post = cfg, max(cfg.post_roll_s, 0.0)

    def _read(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Times, the number of the reason that would begin at each frame (0: none), and for each reason the frames that break it."""
        cfg = self.cfg
        now, closed_s, idle_s = (rows.column(c).to_numpy() for c in ("video_s", "closed_s", "idle_s"))
        active, seen, moving = (rows.column(c).to_numpy() for c in ("active", "activity_seen", "vehicle_moving"))
        closed = pc.equal(rows.column("door_state"), "CLOSED").to_numpy()
        begins = np.select(
            [now < max(cfg.min_seconds, 0.0), np.full(len(now), cfg.max_seconds > 0) & (now >= cfg.max_seconds), closed & (closed_s >= max(cfg.closed_confirm_s, 0.0)) & (idle_s >= max(cfg.clear_s, 0.0)), np.full(len(now), cfg.motion_fallback) & seen & (idle_s >= max(cfg.inactivity_s, 0.0)) & moving],
            [0, 1, 2, 3],
            0,
        )
        return now, begins, {"MAX_DURATION": np.zeros(len(now), bool), "DOOR_CLOSED": active | ~closed, "INACTIVITY_AND_MOVEMENT": active | ~moving}

    def summary(self, rows: pa.Table) -> dict:
        now, begins, breaks = self._read(rows)
        n = len(now)
        starts = np.flatnonzero(begins)

        def after(broken: np.ndarray, place: int) -> int:
            found = np.flatnonzero(broken[place:])
            return place + int(found[0]) if len(found) else n

        def without(place: int) -> list:
            """What becomes of a session that has no candidate before ``place``."""
            while (k := int(np.searchsorted(starts, place))) < len(starts):
                s = int(starts[k])
                reason, since = REASONS[begins[s] - 1], float(now[s])
                end = after(breaks[reason], s + 1)
                if self.cfg.post_roll_s <= 0 or (now[s + 1 : end] - since >= self.post).any():
                    return ["stopped", reason]
                if end == n:
                    return ["held", reason, since]
                place = end + 1
            return ["none"]

        way = {"none": without(0)}
        for reason in REASONS:
            end = after(breaks[reason], 0)
            way[reason] = [float(now[:end].max()) if end else None, without(end + 1) if end < n else None]
        return way

    def _latest(self, a: float | None, b: float | None) -> float | None:
        return b if a is None else a if b is None else max(a, b)

    def apply(self, way: dict, state: list) -> list:
        if state[0] != "held":
            return way["none"] if state[0] == "none" else state
        most, then = way[state[1]]
        if most is not None and most - state[2] >= self.post:
            return ["stopped", state[1]]
        return state if then is None else then

    def then(self, first: dict, second: dict) -> dict:
        way = {"none": self.apply(second, first["none"])}
        for reason in REASONS:
            most, after = first[reason]
            way[reason] = [most, self.apply(second, after)] if after is not None else [self._latest(most, second[reason][0]), second[reason][1]]
        return way

    def replay(self, rows: pa.Table, state: list) -> list[pa.Array]:
        candidate = Candidate(self.cfg, *(state[1:] if state[0] != "none" else ()), **({"stopped": True} if state[0] == "stopped" else {}))
        phases, reasons, stopped = [], [], []
        for r in rows.select(["video_s", "active", "door_state", "closed_s", "idle_s", "activity_seen", "vehicle_moving"]).to_pylist():
            candidate.step(r)
            phases.append("FINISHED" if candidate.stopped else "POST_ROLL" if candidate.reason is not None else {"CALIBRATING": "CALIBRATING", "CLOSED": "CLOSING"}.get(r["door_state"], "MONITORING"))
            reasons.append(candidate.reason)
            stopped.append(candidate.stopped)
        return [rows.column("frame_index").combine_chunks(), rows.column("door_state").combine_chunks(), pa.array(phases), pa.array(reasons, pa.string()), pa.array(stopped)]


def stop_points(frames: DataFrame, cfg: StopConfig, stretch: int = scan.STRETCH, fan: int = scan.FAN) -> DataFrame:
    """Each frame's phase and reason, and whether analysis stops there; rows after a stop keep FINISHED. The candidate runs as a scan over stretches of frames."""
    columns = ["session_id", "frame_index", "video_s", "active", "door_state", "closed_s", "idle_s", "activity_seen", "vehicle_moving"]
    facts = cut(door_states(frames, cfg, stretch).select(*columns), "door-states")
    return scan.scanned(scan.with_stretch(facts, "frame_index", stretch), ["session_id"], ["frame_index"], StopMachine(cfg), fan)
