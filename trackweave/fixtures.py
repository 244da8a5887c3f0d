"""Inputs of the engine's operators, derived from the supplied tables by integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as G

FRAME_W, FRAME_H = 640, 480
#: Polygons in pixels, as (x, y): salon below, street above, door across the line, spawn strip at the bottom.
SALON = [(0.0, 264.0), (640.0, 264.0), (640.0, 480.0), (0.0, 480.0)]
STREET = [(0.0, 0.0), (640.0, 0.0), (640.0, 216.0), (0.0, 216.0)]
DOOR = [(200.0, 150.0), (440.0, 150.0), (440.0, 300.0), (200.0, 300.0)]
SPAWN = [(0.0, 420.0), (640.0, 420.0), (640.0, 480.0), (0.0, 480.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polygon(points: list[tuple[float, float]]):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory samples: every user is a track that swings between street and salon; errors are gaps."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(order) - 1).alias("frame_index"))
    rows = rows.where(F.col("event_type") != "error").withColumn("phase", (F.col("frame_index") * 7 + F.col("user_id") * 13) % 200)
    swing = F.when(F.col("phase") < 100, F.col("phase")).otherwise(200 - F.col("phase"))
    rows = rows.select(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("session_id"), F.col("user_id").cast("int").alias("track_id"),
        F.col("frame_index").alias("seq"), "frame_index",
        (200 + (F.col("user_id") * 37) % 240).cast("double").alias("anchor_x"), (swing * F.lit(4.8)).alias("anchor_y"), (24 + swing * F.lit(0.5)).alias("head_size"),
        (F.lit(0.06) + (F.col("user_id") % 10) * F.lit(0.03)).alias("body_ratio"),
    )
    y = F.col("anchor_y")
    zone = F.when(y > 264, "INSIDE").when(y < 216, "OUTSIDE").otherwise("BUFFER")
    door = (F.col("anchor_x") < 400) & (y >= 150) & (y <= 300)
    return rows.withColumn("zone", zone).withColumn("in_door", door).withColumn("in_spawn", y > 420)


def staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples with tracks that begin one after another."""
    return samples(spark, sf_dir).withColumn("frame_index", F.col("frame_index") + F.floor(F.col("track_id") / 8) % 16 * 37)


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An origin for each track, by its number."""
    track = F.col("track_id") % 5
    name = F.when(track == 0, "STARTUP_DOOR").when(track == 1, "STARTUP_OUTSIDE").when(track == 2, "STARTUP_INSIDE").when(track == 3, "UNKNOWN").otherwise("INVALID")
    return samples(spark, sf_dir).select("session_id", "track_id").distinct().withColumn("origin", name)


def clip_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staggered(spark, sf_dir).groupBy("session_id").agg(F.max("frame_index").cast("int").alias("final_frame_index"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, five in a frame."""
    e = F.col("event_id")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("session_id", F.concat(F.lit("s"), (e % 8).cast("string"))).withColumn("_n", place)
    x1, y1, w, h = (e * 37) % 600, (e * 53) % 420, 24 + e % 40, 30 + (e * 3) % 60
    d = lambda v: v.cast("double")
    return rows.select(
        "session_id", F.floor(F.col("_n") / 5).cast("int").alias("frame_index"), (F.col("_n") % 5).cast("int").alias("det_seq"),
        d(x1).alias("x1"), d(y1).alias("y1"), d(x1 + w).alias("x2"), d(y1 + h).alias("y2"), (((e * 17) % 100) / F.lit(100.0)).alias("confidence"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir)
    return rows.withColumn("box", G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])).withColumn("frame_width", F.lit(FRAME_W)).withColumn("frame_height", F.lit(FRAME_H))


def frame_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of zones, in shares of the frame, for each session."""
    share = lambda ps: polygon([(x / FRAME_W, y / FRAME_H) for x, y in ps])
    rows = detections(spark, sf_dir).select("session_id").distinct()
    return rows.select("session_id", share(SALON).alias("salon"), share(STREET).alias("street"), share(DOOR).alias("door"), share(SPAWN).alias("spawn"), F.lit(FRAME_W).alias("frame_width"), F.lit(FRAME_H).alias("frame_height"))


def walkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that follow the trajectories: a head box around each sample's anchor, all tracks of a session in view."""
    rows = samples(spark, sf_dir)
    half = F.col("head_size") / 2
    return rows.select(
        "session_id", (F.col("frame_index") * 3).cast("int").alias("frame_index"), F.col("track_id").alias("det_seq"),
        (F.col("anchor_x") - half).alias("x1"), (F.col("anchor_y") - half).alias("y1"), (F.col("anchor_x") + half).alias("x2"), (F.col("anchor_y") + half).alias("y2"),
        F.lit(0.9).alias("confidence"),
        G.box(F.col("anchor_x") - F.col("head_size"), F.col("anchor_y") - half, F.col("anchor_x") + F.col("head_size"), F.col("anchor_y") + F.col("head_size") * 3).alias("body"),
        F.lit(None).cast("array<double>").alias("embedding"),
    )


def _placed(events: DataFrame) -> DataFrame:
    """Adds ``k``, each event's place in its session from 0: the place in its hour and the events of the hours before, so that no task numbers a session."""
    rows = events.withColumn("_hour", F.date_trunc("hour", "ts"))
    hours = rows.groupBy("session_id", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("session_id").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select(F.col("session_id").alias("_s"), F.col("_hour").alias("_h"), F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.join(hours, rows["session_id"].eqNullSafe(hours["_s"]) & rows["_hour"].eqNullSafe(hours["_h"]))
    own = F.row_number().over(Window.partitionBy("session_id", "_hour").orderBy("ts", "event_id")) - 1
    return rows.withColumn("k", F.col("_before") + own).drop("_hour", "_s", "_h", "_before")


def door_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of four cells by frame: the door closes for stretches, the street moves now and then, activity is rare."""
    e = F.col("event_id")
    rows = _placed(table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("s"), (e % 8).cast("string")).alias("session_id")))
    k = F.col("k")
    closed = (k % 90) >= 50
    cell = lambda i: F.when(closed, F.lit(0.9 - 0.2 * i)).otherwise(F.lit(0.1 + 0.2 * i))
    street = lambda i: ((k * (i + 1) + F.when((k % 60) > 30, e % 7).otherwise(0)) % 5) * F.lit(0.2)
    quiet = lambda i: F.lit(0.25 * i)
    moving = (k % 60) > 30
    return rows.select(
        "session_id", (k * 5).cast("int").alias("frame_index"), F.lit(10.0).alias("fps"), F.array(*[cell(i) for i in range(4)]).alias("door"),
        F.array(*[F.when(moving, street(i)).otherwise(quiet(i)) for i in range(4)]).alias("street"), ((k % 90) == 2).alias("active"),
    )


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored results."""
    o = table(spark, sf_dir, "orders")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400_000
    return o.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "STOPPED").otherwise("FAILED").alias("status"),
        F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string")).alias("video_device_id"),
        F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 6).cast("int")).alias("channel"),
        F.concat(F.lit("E"), (F.col("o_orderkey") % 9).cast("string")).alias("event_code"),
        F.when(F.col("o_orderkey") % 3 != 0, day).alias("clip_started_ms"), (day + F.col("o_orderkey") % 1000).alias("finished_ms"),
        (F.col("o_orderkey") % 5).cast("int").alias("alightings"), (F.col("o_orderkey") % 7).cast("int").alias("exited"), (F.col("o_orderkey") % 40).cast("int").alias("onboard"),
    )


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as bindings: several a camera, some closed."""
    c = F.col("c_custkey")
    door = F.when(c % 4 == 0, "FRONT").when(c % 4 == 1, "REAR").when(c % 4 == 2, "CUSTOM").otherwise("NEEDS_CLASSIFICATION")
    return table(spark, sf_dir, "customer").select(
        c.alias("id"), F.concat(F.lit("rec"), (c % 30).cast("string")).alias("recorder_id"), (c % 7).cast("string").alias("camera_code"), door.alias("logical_door"),
        F.when(c % 5 != 0, F.col("c_nationkey").cast("bigint")).alias("profile_id"), (c % 3 != 0).alias("active"), (c * 1000).alias("updated_ms"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as profiles; some lack a polygon."""
    k = F.col("n_nationkey")
    shape = lambda m: F.when(k % m == 0, "[]").when(k % m != 1, F.concat(F.lit('[{"x":0.'), k.cast("string"), F.lit(',"y":0.5}]')))
    return table(spark, sf_dir, "nation").select(k.cast("bigint").alias("id"), F.col("n_name").alias("name"), shape(3).alias("door"), shape(4).alias("salon"))


def clip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as video files with paths that hold device, date, channel, event and clip times."""
    k = F.col("o_orderkey")
    folder = F.when(k % 5 == 0, "/data/processed/failed/").when(k % 5 == 1, "/data/processed/").when(k % 5 == 2, "/data/incoming/").when(k % 5 == 3, "/data/videos/").otherwise("/srv/other/")
    start = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400
    name = F.concat_ws("_", (k % 6).cast("string"), F.concat(F.lit("E"), (k % 9).cast("string")), (k % 3).cast("string"), start.cast("string"), (start + 60).cast("string"), F.lit("0"), k.cast("string"))
    device = F.when(k % 11 == 0, "x").otherwise((1000 + F.col("o_custkey") % 50).cast("string"))
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    path = F.concat(folder, device, F.lit("/"), day, F.lit("/"), name, F.when(k % 13 == 0, ".txt").otherwise(".MP4"))
    return table(spark, sf_dir, "orders").select(path.alias("path"), (k * 10).alias("size"), (start * 1000 + k).alias("modified_ms"))
