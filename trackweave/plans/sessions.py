"""Control of sessions: a table of their states, changed by requests, and what clients are told.

SESSIONS is a table like any other: each function returns it anew, or a view of it, and a sink stores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CountConfig, DetectorConfig, StopConfig, TrackConfig

SESSIONS = "session_id string, video_path string, status string, started_ms long, finished_ms long, stop_asked boolean, frames_processed long, total_alightings long, initial_onboard long, error_message string, finish_reason string"


class NoSuchSession(KeyError):
    """There is no session of this id."""


def final_status(ended_by: Column) -> Column:
    """How a session ends: STOPPED by its user, FINISHED at the end of its file or by smart stop, else FAILED."""
    return F.when(ended_by == "USER_STOP", "STOPPED").when(ended_by.isin("END_OF_FILE", "SMART_STOP"), "FINISHED").otherwise("FAILED")


def start(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Sessions with new ones (session_id, video_path, at_ms) running; an id that is there already is left alone."""
    new = requests.dropDuplicates(["session_id"]).join(sessions.select("session_id"), "session_id", "left_anti")
    values = {"session_id": F.col("session_id"), "video_path": F.col("video_path"), "status": F.lit("RUNNING"), "started_ms": F.col("at_ms"), "stop_asked": F.lit(False)}
    values |= {c: F.lit(0) for c in ("frames_processed", "total_alightings", "initial_onboard")}
    return sessions.unionByName(new.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sessions.schema]))


def ask_stop(sessions: DataFrame, session_id: str) -> DataFrame:
    """A running session is asked to stop; for others nothing changes, as for ids that aren't there."""
    hit = (F.col("session_id") == session_id) & (F.col("status") == "RUNNING")
    return sessions.withColumn("stop_asked", F.col("stop_asked") | hit)


def finish(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions after ends (session_id, ended_by, at_ms, finish_reason, error_message); only running ones end."""
    told = ends.select("session_id", F.col("ended_by").alias("_by"), F.col("at_ms").alias("_at"), F.col("finish_reason").alias("_why"), F.col("error_message").alias("_error")).dropDuplicates(["session_id"])
    rows = sessions.join(told, "session_id", "left")
    now = (F.col("status") == "RUNNING") & F.col("_at").isNotNull()
    by = F.when(F.col("stop_asked"), "USER_STOP").otherwise(F.col("_by"))
    values = {"status": final_status(by), "finished_ms": F.col("_at"), "finish_reason": F.col("_why"), "error_message": F.col("_error")}
    return rows.select(*[F.when(now, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sessions.columns])


def onboard(most: int = 120) -> Column:
    return F.least(F.greatest(F.col("initial_onboard") - F.col("total_alightings"), F.lit(0)), F.lit(most))


def state(sessions: DataFrame, session_id: str) -> DataFrame:
    """What a client is told of a session; an id that isn't there raises NoSuchSession."""
    row = sessions.where(F.col("session_id") == session_id)
    if not row.limit(1).count():
        raise NoSuchSession(session_id)
    return row.select("session_id", "status", "frames_processed", F.col("total_alightings").alias("total_exited"), F.lit(0).alias("total_boardings"), "total_alightings", onboard().alias("current_onboard"), "error_message", "finish_reason")


def info(spark: SparkSession, track: TrackConfig, count: CountConfig, detector: DetectorConfig, stop: StopConfig, reid: bool = False) -> DataFrame:
    """The settings that clients show, as one row."""
    values = {
        "reid_enabled": reid, "process_every_n_frames": count.stride, "count_anchor_y_ratio": count.anchor_y, "min_anchor_movement": count.min_move_px, "confidence_threshold": detector.threshold,
        "smart_stop_close_confirm_s": stop.closed_confirm_s, "smart_stop_inactivity_s": stop.inactivity_s, "smart_stop_motion_confirm_s": stop.vehicle_confirm_s, "smart_stop_post_roll_s": stop.post_roll_s,
        "birth_confidence": track.birth_confidence,
    }
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
