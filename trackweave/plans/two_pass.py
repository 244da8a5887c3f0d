"""The whole analysis of sessions: live counting, then fates over the recorded samples, then one result row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CountConfig, FateConfig, TrackConfig
from ..lineage import cut
from ..operators import occupancy as O
from ..operators import tracker
from ..operators import trajectories as R
from ..operators.detections import zone_counts


def analyse(detections: DataFrame, zones: DataFrame, track: TrackConfig, count: CountConfig, fate: FateConfig, mode: str | None = None) -> DataFrame:
    """session_id, live_exits, offline_exits, exits (the greater of both; in ``streaming`` mode the live ones), initial, onboard.

    ``mode`` is the counting configuration's unless given; another than those two raises ValueError. The tracker runs once; what it tells is written to the shared folder and read by all that follows.
    """
    mode = (mode or count.mode).lower()
    if mode not in ("offline", "streaming"):
        raise ValueError(f"unknown count mode: {mode}")
    rows = cut(tracker.folded(detections, zones, track, count), "folded")
    samples = tracker.samples_of(rows)
    clip_end = detections.groupBy("session_id").agg(F.max("frame_index").alias("final_frame_index"))
    offline = R.session_totals(R.track_fates(samples.drop("again"), fate, tracker.origins_of(rows), clip_end)).withColumnRenamed("exits", "offline_exits")
    live = tracker.exits_of(rows).groupBy("session_id").agg(F.sum("exits").alias("live_exits"))
    first = O.initial_occupancy(zone_counts(samples.where("not again")))  # startup frames are recorded twice, but a person counts once
    out = detections.select("session_id").distinct().join(live, "session_id", "left").join(offline, "session_id", "left").join(first, "session_id", "left")
    out = out.fillna(0, ["live_exits", "offline_exits", "initial"])
    exits = F.greatest("live_exits", "offline_exits") if mode == "offline" else F.col("live_exits")
    out = out.withColumn("exits", exits)
    return out.withColumn("onboard", F.least(F.greatest(F.col("initial") - F.col("exits"), F.lit(0)), F.lit(120)))
