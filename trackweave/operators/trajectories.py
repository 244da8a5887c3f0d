"""The second pass: stable visits, transitions, tails, successors, and each track's fate, all as DataFrame plans.

Samples are a bag ordered by (frame_index, seq). Every window is partitioned by (session_id, track_id), so the one
shuffle by session and track serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FateConfig
from ..functions.geometry import distance
from ..lineage import cut
from .near import soon_and_near

TRACK = ["session_id", "track_id"]
ORDER = ["frame_index", "seq"]


def stable_visits(samples: DataFrame, least: int) -> DataFrame:
    """Runs of at least ``least`` samples in one zone, BUFFER left out beforehand: islands between gaps.

    Columns: visit_no from 1, zone, samples, median_head, mean_x, mean_y.
    """
    sided = samples.where(F.col("zone") != "BUFFER")
    place = F.row_number().over(Window.partitionBy(*TRACK).orderBy(*ORDER))
    among = F.row_number().over(Window.partitionBy(*TRACK, "zone").orderBy(*ORDER))
    runs = sided.withColumn("_at", place).withColumn("_island", F.col("_at") - among)
    visits = runs.groupBy(*TRACK, "zone", "_island").agg(
        F.count(F.lit(1)).alias("samples"), F.median("head_size").alias("median_head"), F.avg("anchor_x").alias("mean_x"), F.avg("anchor_y").alias("mean_y"), F.min("_at").alias("_first")
    )
    number = F.row_number().over(Window.partitionBy(*TRACK).orderBy("_first"))
    return visits.where(F.col("samples") >= least).withColumn("visit_no", number).select(*TRACK, "visit_no", "zone", "samples", "median_head", "mean_x", "mean_y")


def transitions(visits: DataFrame) -> DataFrame:
    """Adjacent visits: both zones, the shift of the mean anchor, and the ratio of median heads."""
    before = F.lag(F.struct("zone", "median_head", "mean_x", "mean_y")).over(Window.partitionBy(*TRACK).orderBy("visit_no"))
    pairs = visits.withColumn("_b", before).where(F.col("_b").isNotNull())
    return pairs.select(
        *TRACK, "visit_no", F.col("_b.zone").alias("from_zone"), F.col("zone").alias("to_zone"),
        distance(F.col("_b.mean_x"), F.col("_b.mean_y"), F.col("mean_x"), F.col("mean_y")).alias("shift"),
        _ratio(F.col("_b.median_head"), F.col("median_head")).alias("head_ratio"),
    )


def _ratio(base: Column, value: Column) -> Column:
    return F.when(base <= 1e-6, 1.0).otherwise(value / base)


def track_facts(samples: DataFrame, cfg: FateConfig) -> DataFrame:
    """One row for each track: counts, first, last and last but one sample, what the tail window shows, and how far the first samples lie from the first.

    One sort serves the places from the beginning and, with the track's number of samples, those from the end.
    """
    tail, early = max(cfg.lost_frames, 2), max(cfg.stable_samples, 2)
    whole = Window.partitionBy(*TRACK)
    own = whole.orderBy(*ORDER)
    rows = samples.withColumn("_at", F.row_number().over(own)).withColumn("_start", F.first(F.struct("anchor_x", "anchor_y")).over(own))
    rows = rows.withColumn("_back", F.count(F.lit(1)).over(whole) - F.col("_at") + 1)
    in_tail = F.col("_back") <= tail
    exit_area = F.col("in_door") | (F.col("zone") == "OUTSIDE")
    rank = F.when(F.col("zone") == "OUTSIDE", 2).when(F.col("in_door"), 1).otherwise(0)
    tail_sample = F.struct(F.col("anchor_x").alias("x"), F.col("anchor_y").alias("y"), F.col("head_size").alias("head"), "zone")
    first_sample = F.struct("zone", "in_spawn", "frame_index", F.col("anchor_x").alias("x"), F.col("anchor_y").alias("y"))
    return rows.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("body_ratio").alias("body_ratio"),
        F.bool_or("in_door").alias("ever_in_door"),
        F.min_by(first_sample, F.struct(*ORDER)).alias("first"),
        F.max_by(first_sample, F.struct(*ORDER)).alias("last"),
        F.bool_or(in_tail & exit_area).alias("ends_at_exit"),
        # The last sample outside, else the last in the door, else the last of all.
        F.max_by(tail_sample, F.when(in_tail, F.struct(rank.alias("r"), (-F.col("_back")).alias("b")))).alias("tail"),
        F.max(F.when(F.col("_back") == 2, F.struct(F.col("anchor_x").alias("x"), F.col("anchor_y").alias("y")))).alias("before_last"),
        F.max(F.when(F.col("_at") <= early, distance(F.col("_start.anchor_x"), F.col("_start.anchor_y"), F.col("anchor_x"), F.col("anchor_y")))).alias("early_shift"),
    )


def early_shift(samples: DataFrame, first_n: int) -> DataFrame:
    """The furthest that each track's first samples lie from its first one."""
    own = Window.partitionBy(*TRACK).orderBy(*ORDER)
    start = F.first(F.struct("anchor_x", "anchor_y")).over(own)
    rows = samples.withColumn("_n", F.row_number().over(own)).withColumn("_s", start).where(F.col("_n") <= first_n)
    return rows.groupBy(*TRACK).agg(F.max(distance(F.col("_s.anchor_x"), F.col("_s.anchor_y"), F.col("anchor_x"), F.col("anchor_y"))).alias("early_shift"))


def with_stationary_successor(samples: DataFrame, cfg: FateConfig, facts: DataFrame | None = None) -> DataFrame:
    """Tracks that another track follows closely in time and place while standing still: a join on cells of space and time."""
    facts = track_facts(samples, cfg) if facts is None else facts
    at = lambda which: [F.col(f"{which}.x").alias("x"), F.col(f"{which}.y").alias("y"), F.col(f"{which}.frame_index").alias("t")]
    births = facts.where(F.col("early_shift") < cfg.min_move_px).select("session_id", F.col("track_id"), *at("first"))
    gap = F.col("t_b") - F.col("t")
    close = (F.col("track_id") != F.col("track_id_b")) & (gap > 0) & (gap <= cfg.successor_gap) & (distance(F.col("x"), F.col("y"), F.col("x_b"), F.col("y_b")) <= cfg.successor_px)
    return soon_and_near(facts.select(*TRACK, *at("last")), births, ["session_id"], cfg.successor_px, cfg.successor_gap, only=close).select(*TRACK)


def track_fates(samples: DataFrame, cfg: FateConfig, origins: DataFrame | None = None, clip_end: DataFrame | None = None) -> DataFrame:
    """session_id, track_id, exits, fate. ``origins``: (session_id, track_id, origin); ``clip_end``: (session_id, final_frame_index)."""
    facts = cut(track_facts(samples, cfg), "facts")  # a row for each track, read three times
    visits = stable_visits(samples, cfg.stable_samples)
    order = F.col("visit_no")
    before = F.lag(F.struct("zone", "median_head", "mean_x", "mean_y")).over(Window.partitionBy(*TRACK).orderBy("visit_no"))
    out = (F.col("zone") == "OUTSIDE") & (F.col("_b.zone") == "INSIDE") & (distance(F.col("_b.mean_x"), F.col("_b.mean_y"), F.col("mean_x"), F.col("mean_y")) >= cfg.min_move_px)
    seen = visits.withColumn("_b", before).withColumn("_out", F.coalesce(out, F.lit(False))).groupBy(*TRACK).agg(
        F.count_if("_out").alias("moved_out"),
        F.count_if(F.col("_out") & (_ratio(F.col("_b.median_head"), F.col("median_head")) <= cfg.shrink_ratio)).alias("shrank_out"),
        F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("zone") == "INSIDE").alias("inside"),
        F.count_if(F.col("zone") == "OUTSIDE").alias("outside"),
        F.min_by("zone", order).alias("first_zone"),
        F.max_by("zone", order).alias("last_zone"),
        F.max_by(F.struct("median_head", "mean_x", "mean_y"), F.when(F.col("zone") == "INSIDE", order)).alias("within"),
    )
    followed = with_stationary_successor(samples, cfg, facts).withColumn("followed", F.lit(True))

    rows = facts.join(seen, TRACK, "left").join(followed, TRACK, "left")
    rows = rows.join(origins.select(*TRACK, "origin"), TRACK, "left") if origins is not None else rows.withColumn("origin", F.lit(None).cast("string"))
    rows = rows.join(clip_end.select("session_id", "final_frame_index"), "session_id", "left") if clip_end is not None else rows.withColumn("final_frame_index", F.lit(None).cast("int"))

    c = F.col
    born = F.when((c("first.zone") == "INSIDE") & c("first.in_spawn"), "SPAWN_INSIDE").otherwise("INVALID")
    origin = F.when(c("origin").isNotNull() & (c("origin") != "UNKNOWN"), c("origin")).otherwise(born)
    at_exit = origin.isin("STARTUP_DOOR", "STARTUP_OUTSIDE")
    visible = F.coalesce(c("final_frame_index") - c("last.frame_index") <= max(cfg.lost_frames, 2), F.lit(False))
    none = F.coalesce(c("visits"), F.lit(0)) == 0
    startup = F.when(at_exit & (((c("inside") == 0) & ~visible) | ((origin == "STARTUP_DOOR") & (c("first_zone") == "OUTSIDE"))), 1).otherwise(0)
    allowed = ~F.lit(cfg.require_exit_origin) | (origin != "INVALID")
    crossings = F.when(allowed, F.coalesce(F.when(c("ever_in_door"), c("moved_out")).otherwise(c("shrank_out")), F.lit(0))).otherwise(0)
    shift = lambda x, y: distance(c("within.mean_x"), c("within.mean_y"), x, y)
    shrank = _ratio(c("within.median_head"), c("tail.head")) <= cfg.shrink_ratio
    lost = (
        allowed & c("followed").isNull() & (c("last_zone") == "INSIDE") & c("ends_at_exit")
        & (shift(c("tail.x"), c("tail.y")) >= cfg.min_move_px)
        & (shift(c("before_last.x"), c("before_last.y")) >= cfg.min_move_px * 0.6)
        & (shrank | (c("tail.zone") == "OUTSIDE"))
    )
    counted = F.when(startup > 0, startup).when(crossings > 0, crossings).when(F.coalesce(lost, F.lit(False)), 1).otherwise(0)
    far = ~at_exit & F.lit(cfg.min_body_ratio > 0) & (c("body_ratio") < cfg.min_body_ratio)
    few = c("n") < cfg.stable_samples
    exits = F.when(few | far, 0).when(none, F.when(at_exit & ~visible, 1).otherwise(0)).otherwise(counted).cast("long")
    fate = (
        F.when(few, "UNDECIDED").when(far, "PASSERBY").when(exits > 0, "EXITED").when(none, "UNDECIDED")
        .when(c("inside") == c("visits"), "ONBOARD_STATIONARY")
        .when((c("outside") == c("visits")) & ~c("ever_in_door"), "PASSERBY")
        .otherwise("UNDECIDED")
    )
    return rows.select(*TRACK, exits.alias("exits"), fate.alias("fate"))


def session_totals(fates: DataFrame, streaming: DataFrame | None = None) -> DataFrame:
    """Exits of each session; with live totals (session_id, live_exits) the greater of the two."""
    totals = fates.groupBy("session_id").agg(F.sum("exits").alias("exits"))
    if streaming is None:
        return totals
    both = totals.join(streaming, "session_id", "full_outer")
    return both.select("session_id", F.greatest(F.coalesce("exits", F.lit(0)), F.coalesce("live_exits", F.lit(0))).alias("exits"))


def fate_counts(fates: DataFrame) -> DataFrame:
    return fates.groupBy("session_id", "fate").agg(F.count(F.lit(1)).alias("tracks"))


def head_average(samples: DataFrame, window: int) -> DataFrame:
    """The moving average of head sizes over the last ``window`` samples of a track."""
    own = Window.partitionBy(*TRACK).orderBy(*ORDER).rowsBetween(1 - max(window, 2), 0)
    return samples.withColumn("smooth_head", F.avg("head_size").over(own))


def lifetime_shift(samples: DataFrame) -> DataFrame:
    """The diagonal of all anchors of a track."""
    spread = lambda c: F.max(c) - F.min(c)
    sides = samples.groupBy(*TRACK).agg(spread("anchor_x").alias("_dx"), spread("anchor_y").alias("_dy"))
    return sides.select(*TRACK, F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).alias("lifetime_shift"))
