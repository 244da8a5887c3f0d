"""Appearance: the best match of a detection among lost tracks, and the positional fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrackConfig
from ..functions import geometry as G
from ..functions import vectors as V
from .detections import center_limit


def pool(lost: DataFrame, coasting: DataFrame) -> DataFrame:
    """Tracks that a detection may belong to: the archived ones, then those not seen for a while, with the name of their pool."""
    return lost.withColumn("pool", F.lit("lost")).unionByName(coasting.withColumn("pool", F.lit("coasting")))


def best_match(probes: DataFrame, pool: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Each probe's most similar pool row above the threshold; ties go to the smaller pool id.

    ``keys`` (session and frame) keep the join equal-keyed and local; embeddings are normalised. It scores all pairs of a key, which suits the
    few tracks of a frame; for pools as long as an archive there is ``similar.best_match``, with the same rows.
    """
    pairs = probes.join(pool, keys).where(F.col("probe_id") != F.col("pool_id"))
    scored = pairs.withColumn("similarity", V.dot(F.col("probe_embedding"), F.col("pool_embedding"))).where(F.col("similarity") > threshold)
    best = F.max(F.struct("similarity", (-F.col("pool_id")).alias("_minus")))
    return scored.groupBy(*keys, "probe_id").agg(best.alias("_b")).select(*keys, "probe_id", (-F.col("_b._minus")).alias("pool_id"), F.col("_b.similarity").alias("similarity"))


def position_fallback(probes: DataFrame, pool: DataFrame, cfg: TrackConfig) -> DataFrame:
    """The nearest recently lost, uncounted track with salon or door history for detections at the exit.

    Both sides are as of a frame, so that a detection meets the tracks of its own session and frame only.
    """
    keys = ["session_id", "frame_index"]
    pairs = probes.where("at_exit").join(pool.where((F.col("lost") <= cfg.fallback_lost) & F.col("has_history") & ~F.col("alighted")), keys)
    far = G.distance(F.col("x"), F.col("y"), F.col("track_x"), F.col("track_y"))
    limit = F.least(F.lit(cfg.fallback_px), center_limit(F.col("box"), F.col("track_box"), cfg) * 2)
    near = pairs.withColumn("px", far).where(F.col("px") <= limit)
    return near.groupBy(*keys, "det_seq").agg(F.min(F.struct("px", "track_id")).alias("_b")).select(*keys, "det_seq", F.col("_b.track_id").alias("track_id"), F.col("_b.px").alias("px"))
