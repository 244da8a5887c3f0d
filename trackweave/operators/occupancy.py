"""Occupancy of a session: how many are aboard at first, and after exits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def initial_occupancy(counts: DataFrame, frames: int = 25) -> DataFrame:
    """The most people inside in one of the first ``frames`` frames that hold anyone."""
    filled = counts.where(F.col("inside") + F.col("outside") + F.col("buffer") > 0)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("frame_index"))
    return filled.withColumn("_n", place).where(F.col("_n") <= frames).groupBy("session_id").agg(F.max("inside").alias("initial"))


def occupancy(initial: DataFrame, totals: DataFrame, most: int = 120) -> DataFrame:
    """Initial occupancy and boardings less exits, held within 0 and ``most``."""
    both = initial.join(totals, "session_id", "left")
    left = F.col("initial") + F.coalesce("boardings", F.lit(0)) - F.coalesce("exits", F.lit(0))
    return both.select("session_id", F.least(F.greatest(left, F.lit(0)), F.lit(most)).alias("onboard"))
