"""The registered queries of the engine's own operators, over whole tables. SQL for the same rows is in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .config import BoxConfig, CountConfig, DetectorConfig, FateConfig, LineConfig, StopConfig, TrackConfig
from .functions import geometry as G
from .functions import paths as P
from .functions import vectors as V
from .operators import catalog, detections, door_config, line_counter, messages, occupancy, reid, results, scan, similar, smart_stop, tracker, trajectories
from .plans import sessions, two_pass
from .lineage import cut, shared_dir
from .sources import files
from .sources.table_log import TableLog

FATE, COUNT, TRACK, BOX, STOP, LINE = FateConfig(), CountConfig(), TrackConfig(), BoxConfig(), StopConfig(need_activity=True), LineConfig(inside_on_top=False)
#: Wider limits, since derived tracks move fast: so that they show every rule.
DERIVED = FateConfig(min_move_px=100.0, successor_px=400.0)

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def trajectory_samples(spark, d):
    return rounded(X.samples(spark, d).withColumn("frame_index", F.col("frame_index").cast("long")).drop("seq"), "anchor_y", "head_size", "body_ratio")


@query
def stable_visits(spark, d):
    return rounded(trajectories.stable_visits(X.samples(spark, d), FATE.stable_samples), "median_head", "mean_x", "mean_y")


@query
def visit_transitions(spark, d):
    visits = trajectories.stable_visits(X.samples(spark, d), FATE.stable_samples)
    return rounded(trajectories.transitions(visits), "shift", "head_ratio")


@query
def exits_by_visits(spark, d):
    pairs = trajectories.transitions(trajectories.stable_visits(X.samples(spark, d), FATE.stable_samples))
    out = pairs.where((F.col("from_zone") == "INSIDE") & (F.col("to_zone") == "OUTSIDE") & (F.col("shift") >= FATE.min_move_px))
    return out.groupBy("session_id", "track_id").agg(F.count(F.lit(1)).alias("exits"))


@query
def track_facts(spark, d):
    rows = trajectories.track_facts(X.samples(spark, d), FATE)
    rows = rows.select("session_id", "track_id", "n", "body_ratio", "ever_in_door", "ends_at_exit", F.col("tail.zone").alias("tail_zone"), F.col("tail.y").alias("tail_y"), F.col("before_last.y").alias("before_last_y"))
    return rounded(rows, "body_ratio", "tail_y", "before_last_y")


@query
def early_shift(spark, d):
    return rounded(trajectories.early_shift(X.samples(spark, d), 3), "early_shift")


@query
def stationary_successors(spark, d):
    return trajectories.with_stationary_successor(X.staggered(spark, d), DERIVED)


@query
def track_fates(spark, d):
    return trajectories.track_fates(X.staggered(spark, d), DERIVED, X.origins(spark, d), X.clip_ends(spark, d))


@query
def fate_counts(spark, d):
    return trajectories.fate_counts(track_fates(spark, d))


@query
def session_exits(spark, d):
    return trajectories.session_totals(track_fates(spark, d))


@query
def final_exits(spark, d):
    live = X.samples(spark, d).groupBy("session_id").agg(F.count_if("in_spawn").alias("live_exits"))
    return trajectories.session_totals(track_fates(spark, d), live.withColumn("live_exits", F.floor(F.col("live_exits") / 10)))


@query
def head_average(spark, d):
    rows = trajectories.head_average(X.samples(spark, d), COUNT.head_window)
    return rounded(rows.select("session_id", "track_id", F.col("frame_index").cast("long").alias("frame_index"), "smooth_head"), "smooth_head")


@query
def lifetime_shift(spark, d):
    return rounded(trajectories.lifetime_shift(X.samples(spark, d)), "lifetime_shift")


@query
def line_counts(spark, d):
    return line_counter.line_counts(X.samples(spark, d), 240.0, 24.0, LINE)


def _labelled(spark, d) -> DataFrame:
    rows = X.boxes(spark, d)
    x, y = G.anchor(F.col("box"), 0.5, 0.5)
    zone = G.zone_label(x, y, X.polygon(X.SALON), X.polygon(X.STREET))
    return rows.withColumn("zone", zone).withColumn("in_door", G.point_in_polygon(x, y, X.polygon(X.DOOR)))


@query
def zone_labels(spark, d):
    return _labelled(spark, d).select("session_id", "frame_index", "det_seq", "zone", "in_door")


@query
def zone_counts(spark, d):
    return detections.zone_counts(_labelled(spark, d))


@query
def slanted_polygon(spark, d):
    shape = X.polygon([(100.0, 50.0), (600.0, 120.0), (430.0, 460.0), (300.0, 200.0), (60.0, 400.0)])
    x, y = G.anchor(F.col("box"), 0.5, 0.95)
    rows = X.boxes(spark, d).where(G.point_in_polygon(x, y, shape))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("held"))


@query
def initial_occupancy(spark, d):
    return occupancy.initial_occupancy(detections.zone_counts(_labelled(spark, d)))


@query
def session_occupancy(spark, d):
    totals = session_exits(spark, d).withColumn("boardings", F.lit(0))
    return occupancy.occupancy(initial_occupancy(spark, d), totals)


@query
def sampled_frames(spark, d):
    return detections.sampled(X.detections(spark, d), 2).groupBy("session_id").agg(F.count_distinct("frame_index").alias("frames"))


@query
def frame_point_read(spark, d):
    return detections.first_frame_from(X.detections(spark, d).where("session_id = 's1' and det_seq = 0").select("frame_index", "x1", "y1"), 10)


@query
def stream_headers(spark, d):
    rows = X.detections(spark, d).withColumn("fps", F.when(F.col("session_id") != "s3", 30.0))
    return rounded(detections.stream_info(rows), "duration_s")


def _flat(rows: DataFrame, *columns: str) -> DataFrame:
    out = rows.select("session_id", "frame_index", "det_seq", *[F.round(F.col(f"{b}.{p}"), 6).alias(f"{b}_{p}") for b in columns for p in ("x1", "y1", "x2", "y2")])
    return out


@query
def head_regions(spark, d):
    return _flat(detections.tracking_boxes(X.boxes(spark, d), "person", BOX), "head")


@query
def synthetic_bodies(spark, d):
    rows = X.boxes(spark, d)
    return _flat(rows.withColumn("body", G.synthetic_body(F.col("box"), F.col("frame_width"), F.col("frame_height"), BOX)), "body")


@query
def native_heads(spark, d):
    return _flat(detections.tracking_boxes(X.boxes(spark, d), "head", BOX), "head", "body")


@query
def letterbox_boxes(spark, d):
    box = G.from_letterbox(F.col("box"), F.lit(0.8), F.lit(16.0), F.lit(40.0), F.lit(640), F.lit(480))
    return _flat(X.boxes(spark, d).withColumn("frame", box), "frame")


DETECTOR = DetectorConfig(form="auto")


def _detector_values() -> F.Column:
    """A row of detector output in one of four forms, by the box's number."""
    e, to = F.col("det_seq"), lambda v: v.cast("double")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    score, kind = F.col("confidence"), to(F.lit(0))
    centre = F.array((x1 + x2) / 2, (y1 + y2) / 2 + 80, x2 - x1, y2 - y1, score, kind)
    shares = F.array((x1 + x2) / 1280, ((y1 + y2) / 2 + 80) / 640, (x2 - x1) / 640, (y2 - y1) / 640, score, kind)
    batch = F.array(to(F.lit(0)), to(F.lit(1)), x1, y1 + 80, x2, y2 + 80)
    corners = F.array(x1 + 0.5, y1 + 80.5, x2 + 0.5, y2 + 80.5, score, kind)
    return F.when(e == 0, centre).when(e == 1, shares).when(e == 2, batch).when(e == 3, F.slice(centre, 1, 4)).otherwise(corners)


@query
def detector_rows(spark, d):
    rows = X.boxes(spark, d).withColumn("r", detections.parse_row(_detector_values(), DETECTOR, F.col("frame_width"), F.col("frame_height"))).where("r is not null")
    flat = rows.select("session_id", "frame_index", "det_seq", F.round("r.score", 6).alias("score"), *[F.round(F.col(f"r.box.{c}"), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return flat


@query
def detector_outputs(spark, d):
    """Every dozen frames are one output, of planes in every other session, of rows in the others."""
    rows = X.boxes(spark, d).withColumn("output_no", F.floor(F.col("frame_index") / 12).cast("int"))
    box = F.struct("frame_index", "det_seq", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 + 80).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "confidence")
    whole = rows.groupBy("session_id", "output_no").agg(F.array_sort(F.collect_list(box)).alias("b"))
    zero = F.lit(0.0)
    planes = F.array(*[F.concat(F.col("b").getField(c), F.array_repeat(zero, F.greatest(61 - F.size("b"), F.lit(0)))) for c in ("cx", "cy", "w", "h", "confidence")])
    lines = F.transform("b", lambda x: F.array(x["cx"], x["cy"], x["w"], x["h"], x["confidence"], F.lit(0.0)))
    outputs = whole.select("session_id", F.col("output_no").alias("frame_index"), F.lit(640).alias("frame_width"), F.lit(480).alias("frame_height"), F.when(F.substring("session_id", 2, 1).cast("int") % 2 == 1, planes).otherwise(lines).alias("output"))
    found = detections.parse_output(outputs, DetectorConfig())
    return found.select("session_id", "frame_index", "det_seq", F.round("score", 6).alias("score"), *[F.round(F.col(f"box.{c}"), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def line_doors(spark, d):
    """Suppliers as lines in frames of three sizes."""
    k = F.col("s_suppkey")
    size = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    share = lambda n, m: (k * n % m) / F.lit(100.0)
    door = G.line_door(share(7, 101), share(11, 103), share(13, 97), share(17, 89), size(640, 1280, 352), size(480, 720, 288))
    rows = X.table(spark, d, "supplier").select(k.alias("line_id"), door.alias("door"))
    return rows.select("line_id", *[F.round(F.col(f"door.{c}"), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def plane_scores(spark, d):
    one = lambda c: F.collect_list(c)
    rows = X.detections(spark, d).groupBy("session_id", "frame_index").agg(F.array_sort(one(F.struct("det_seq", "x1", "y1", "x2", "y2", "confidence"))).alias("r"))
    part = lambda f: F.transform("r", f)
    planes = rows.select(
        "session_id", "frame_index", part(lambda r: (r["x1"] + r["x2"]) / 2).alias("cx"), part(lambda r: (r["y1"] + r["y2"]) / 2).alias("cy"), part(lambda r: r["x2"] - r["x1"]).alias("w"), part(lambda r: r["y2"] - r["y1"]).alias("h"),
        F.array(part(lambda r: r["confidence"]), part(lambda r: 1 - r["confidence"])).alias("scores"),
    )
    found = detections.plane_scores(planes)
    return found.select("session_id", "frame_index", "anchor", F.round("score", 6).alias("score"), "kind", F.round("box.x1", 6).alias("box_x1"))


def _against_last(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = X.boxes(spark, d).select("session_id", "frame_index", "det_seq", "box")
    before = rows.select("session_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("det_seq").alias("track_id"), F.col("box").alias("track_box"))
    return before, rows


@query
def overlap_candidates(spark, d):
    tracks, boxes = _against_last(spark, d)
    return rounded(detections.overlap_candidates(tracks, boxes, TrackConfig(min_iou=0.05)).select("session_id", "frame_index", "track_id", "det_seq", "iou", "center_px"), "iou", "center_px")


@query
def center_candidates(spark, d):
    tracks, boxes = _against_last(spark, d)
    cfg = TRACK
    taken = detections.overlap_candidates(tracks, boxes, cfg)
    return rounded(detections.center_candidates(tracks, boxes, taken, cfg).select("session_id", "frame_index", "track_id", "det_seq", "center_px"), "center_px")


@query
def greedy_matches(spark, d):
    tracks, boxes = _against_last(spark, d)
    return rounded(detections.greedy(detections.overlap_candidates(tracks, boxes, TrackConfig(min_iou=0.05)), ["-iou", "center_px"]), "iou", "center_px")


@query
def suppressed_boxes(spark, d):
    return detections.suppress_overlaps(X.detections(spark, d), 0.2)


@query
def reid_best_match(spark, d):
    """Ten vectors a frame; the pool of a frame are the vectors of the frame before."""
    e = X.table(spark, d, "embeddings").withColumn("frame_index", F.floor(F.col("vec_id") / 10))
    unit = V.normalise(F.col("embedding"))
    probes = e.select("frame_index", F.col("vec_id").alias("probe_id"), unit.alias("probe_embedding"))
    pool = e.select((F.col("frame_index") + 1).alias("frame_index"), F.col("vec_id").alias("pool_id"), unit.alias("pool_embedding"))
    return rounded(reid.best_match(probes, pool, ["frame_index"], 0.1), "similarity")


@query
def blended_embeddings(spark, d):
    e = X.table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("newer"))
    mixed = e.join(other, "vec_id").withColumn("m", V.blend(F.col("embedding"), F.col("newer"), TRACK.blend))
    return mixed.select("vec_id", F.round(F.get("m", 0), 6).alias("m0"), F.round(F.get("m", 63), 6).alias("m63"))


@query
def reid_archive_match(spark, d):
    """Each vector's best match in the whole archive of its label."""
    e = X.table(spark, d, "embeddings")
    unit = V.normalise(F.col("embedding"))
    probes = e.select("label", F.col("vec_id").alias("probe_id"), unit.alias("probe_embedding"))
    return rounded(similar.best_match(probes, e.select("label", F.col("vec_id").alias("pool_id"), unit.alias("pool_embedding")), ["label"], 0.1), "similarity")


@query
def position_fallback(spark, d):
    """The boxes of a frame against those of the frame before, as lost tracks."""
    rows = X.boxes(spark, d)
    x, y = G.anchor(F.col("box"), 0.5, 0.5)
    probes = rows.select("session_id", "frame_index", "det_seq", "box", x.alias("x"), y.alias("y"), (y < 300).alias("at_exit"))
    pool = rows.select(
        "session_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("det_seq").alias("track_id"), F.col("box").alias("track_box"), x.alias("track_x"), y.alias("track_y"),
        (F.col("frame_index") % 30).alias("lost"), (F.col("det_seq") != 1).alias("has_history"), (F.col("frame_index") % 7 == 0).alias("alighted"),
    )
    return rounded(reid.position_fallback(probes, pool, TRACK), "px")


@query
def path_metadata(spark, d):
    rows = X.clip_files(spark, d).withColumns(P.video_metadata(F.col("path")))
    epoch = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return rows.select("path", "video_device_id", F.col("record_date").cast("string").alias("record_date"), "relative_path", "channel", "camera_code", "event_code", "record_type", epoch("clip_started_at").alias("clip_started_s"), epoch("clip_finished_at").alias("clip_finished_s"), "file_flag", "file_uid")


def _roots(spark) -> DataFrame:
    return spark.createDataFrame([("/data/incoming", "FTP_INCOMING", 0), ("/data/processed", "FTP_PROCESSED", 1), ("/data/videos", "VIDEOS", 2), ("/srv", "VIDEOS", 2)], "root string, kind string, priority int")


@query
def file_catalog(spark, d):
    files = X.clip_files(spark, d).withColumn("size", F.when(F.col("size") % 70 == 0, F.lit(0)).otherwise(F.col("size")))
    return catalog.videos(files, _roots(spark)).select("path", "location", "folder", "below_root", "modified", "can_preview", "can_analyse", "issue")


@query
def preview_answers(spark, d):
    clips = X.clip_files(spark, d).withColumn("size", F.when(F.col("size") % 70 == 0, F.lit(0)).otherwise(F.col("size")))
    k = F.col("o_orderkey")
    other = X.table(spark, d, "orders").select(F.when(k % 2 == 0, F.concat(F.lit("/nowhere/"), k.cast("string"), F.lit(".mp4"))).otherwise(F.concat(F.lit("/data/videos/"), k.cast("string"), F.lit(".mp4"))).alias("path"))
    return catalog.preview_answers(clips.select("path").union(other), clips, _roots(spark))


@query
def recorder_samples(spark, d):
    return catalog.sample_videos(X.clip_files(spark, d), "/data", "1007", "3", 4).select("path", "modified_ms")


@query
def page_extensions(spark, d):
    path = F.regexp_replace("url", r"[?#].*$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return X.table(spark, d, "pages").select("page_id", P.extension(last).alias("extension"), P.safe_segment(last, "index").alias("safe_name"))


@query
def clock_texts(spark, d):
    return X.detections(spark, d).select("session_id", "frame_index").distinct().withColumn("clock", P.clock_text(F.col("frame_index") * 9, F.lit(25.0)))


@query
def deepest_root(spark, d):
    roots = spark.createDataFrame([("/data", "ANY", 3), ("/data/processed", "ARCHIVE", 1), ("/data/processed/failed", "FAILED", 2), ("/srv", "OTHER", 1)], "root string, kind string, priority int")
    return catalog.deepest_root(X.clip_files(spark, d), roots).groupBy("root", "kind").agg(F.count(F.lit(1)).alias("files"))


@query
def first_by_root(spark, d):
    n = X.table(spark, d, "nation")
    roots = n.select(F.concat(F.lit("/r"), F.col("n_regionkey").cast("string")).alias("root"), F.col("n_name").alias("kind"), (F.col("n_nationkey") % 3).alias("priority"))
    return catalog.first_by_root(roots)


@query
def camera_keys(spark, d):
    other = X.table(spark, d, "supplier").select(F.concat(F.lit("rec"), (F.col("s_suppkey") % 40).cast("string")).alias("recorder_id"), (F.col("s_suppkey") % 9).cast("string").alias("camera_code"))
    return door_config.camera_keys(X.bindings(spark, d), other)


@query
def recorder_bindings(spark, d):
    return door_config.of_recorder(X.bindings(spark, d), " rec7 ").select("id", "camera_code", "logical_door", "updated_ms")


@query
def lost_pool(spark, d):
    rows = X.samples(spark, d).groupBy("session_id", "track_id").agg(F.max("frame_index").cast("long").alias("last_frame"))
    return reid.pool(rows.where("last_frame < 60"), rows.where("last_frame >= 60"))


@query
def unprocessed_content(spark, d):
    docs = catalog.content_hash(X.table(spark, d, "documents"), "text").select("sha256", F.format_string("p%010d", "doc_id").alias("path"))
    done = docs.where("substr(sha256, 1, 1) in ('0', '1', '2', '3')").select(F.col("sha256").alias("file_sha256"))
    return catalog.unprocessed(docs, done)


@query
def unanalysed_clips(spark, d):
    files = X.clip_files(spark, d).withColumns(P.video_metadata(F.col("path"))).withColumn("sha256", F.sha2(F.col("path"), 256))
    # Names are read once: results are made of the same files.
    clips = files = cut(files.select("path", "sha256", "relative_path", "video_device_id", "file_uid"), "clip-names")
    done = files.where("file_uid % 4 = 0").select(
        F.when(F.col("file_uid") % 8 == 0, F.col("sha256")).alias("file_sha256"), F.when(F.col("file_uid") % 12 == 0, F.col("relative_path")).alias("original_path"),
        F.when(F.col("file_uid") % 20 == 0, F.col("video_device_id")).alias("video_device_id"), "file_uid", F.lit("FINISHED").alias("status"),
    )
    return catalog.unanalysed(clips, done).select("path")


@query
def latest_preview(spark, d):
    return door_config.latest(X.bindings(spark, d), ["recorder_id", "camera_code"], "updated_ms")


DEFAULTS = {"door": '[{"x":0.4,"y":0.4}]', "salon": '[{"x":0.0,"y":0.6}]'}


@query
def resolved_doors(spark, d):
    clips = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("clip_id"), F.concat(F.lit("rec"), (F.col("s_suppkey") % 40).cast("string")).alias("recorder_id"), (F.col("s_suppkey") % 9).cast("string").alias("camera_code"))
    return door_config.resolve(clips, X.bindings(spark, d), X.profiles(spark, d), DEFAULTS)


@query
def known_channels(spark, d):
    files = X.table(spark, d, "supplier").select(F.concat(F.lit("rec"), (F.col("s_suppkey") % 40).cast("string")).alias("recorder_id"), (F.col("s_suppkey") % 9).cast("string").alias("camera_code"), (F.col("s_suppkey") * 7).alias("modified_ms"))
    return door_config.channels(door_config.latest(X.bindings(spark, d).where("active"), ["recorder_id", "camera_code"], "updated_ms"), files)


@query
def listed_bindings(spark, d):
    return door_config.listed(X.bindings(spark, d), X.profiles(spark, d)).select("id", "recorder_id", "camera_code", "logical_door", "profile_name", "updated_ms")


@query
def named_profiles(spark, d):
    return door_config.profiles_by_name(X.profiles(spark, d)).select("id", "name")


@query
def rebound_cameras(spark, d):
    asked = X.table(spark, d, "nation").select(
        F.concat(F.lit("rec"), (F.col("n_nationkey") % 10).cast("string")).alias("recorder_id"), (F.col("n_nationkey") % 7).cast("string").alias("camera_code"),
        F.lit(" front ").alias("logical_door"), F.col("n_nationkey").cast("bigint").alias("profile_id"), (F.col("n_nationkey") + 9_000_000).cast("bigint").alias("at_ms"),
    )
    return door_config.bind(X.bindings(spark, d), asked)


@query
def upserted_results(spark, d):
    old = X.stored_results(spark, d).select("session_id", "status", "finished_ms")
    new = old.where("finished_ms % 3 = 0").select("session_id", F.lit("STOPPED").alias("status"), (F.col("finished_ms") + 5).alias("finished_ms"))
    return results.upsert(old, new.union(new.withColumn("finished_ms", F.col("finished_ms") - 2)), "session_id", "finished_ms")


@query
def logged_results(spark, d):
    """Orders as results that a stream writes into a versioned table, in two batches; the second comes twice, and the last has other rows by then."""
    log = TableLog(spark, f"{shared_dir(spark)}/trackweave-results-{uuid.uuid4().hex}", 8)
    rows = X.stored_results(spark, d).select("session_id", "status", "finished_ms")
    later = rows.where(F.col("finished_ms") % 3 == 0).withColumn("status", F.lit("STOPPED")).withColumn("finished_ms", F.col("finished_ms") + 5)
    log.upsert(rows, "session_id", "finished_ms", ("orders", 0))
    log.upsert(later, "session_id", "finished_ms", ("orders", 1))
    log.upsert(later.withColumn("status", F.lit("LOST")).withColumn("finished_ms", F.col("finished_ms") + 9), "session_id", "finished_ms", ("orders", 1))
    return log.load()


@query
def result_search(spark, d):
    rows = results.search(X.stored_results(spark, d), device="  ", status="FINISHED", from_ms=700_000_000_000, to_ms=850_000_000_000)
    return results.response(rows).drop("line_x1", "line_y1", "line_x2", "line_y2")


@query
def result_page(spark, d):
    return results.page(X.stored_results(spark, d), 2, 20).select("session_id", "finished_ms")


@query
def result_pages(spark, d):
    return results.page_count(X.stored_results(spark, d), 20)


@query
def results_by_device(spark, d):
    return results.by_device(X.stored_results(spark, d), "d7").select("session_id", results.effective_time().alias("at_ms"))


@query
def result_lookup(spark, d):
    return results.lookup(X.stored_results(spark, d), "r1").select("session_id", "status")


@query
def result_text_filter(spark, d):
    return results.text_filter(X.stored_results(spark, d), " E8 ", ["session_id", "status", "video_device_id", "channel", "event_code"]).select("session_id")


@query
def json_points(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.format_string('[{"x":0.%d,"y":0.5},{"x":1.5,"y":0.25},{"x":0.0,"y":-1.0}]', F.col("event_id") % 10)).when(F.col("event_id") % 3 == 1, "not json").otherwise("[]")
    held = G.clean_polygon(P.points_from_json(text))
    return X.table(spark, d, "events").select("event_id", F.size(held).alias("points"), F.get(held, 1)["x"].alias("second_x"), F.get(held, 2)["y"].alias("third_y"))


@query
def idle_seconds(spark, d):
    return rounded(smart_stop.with_past(scan.with_stretch(smart_stop.timed(X.door_frames(spark, d)), "frame_index")).select("session_id", "frame_index", "video_s", "activity_seen", "idle_s"), "video_s", "idle_s")


@query
def door_states(spark, d):
    rows = smart_stop.door_states(X.door_frames(spark, d), STOP)
    return rounded(rows.select("session_id", "frame_index", "door_state", "door_confidence", "gap", "door_motion", "scene_motion", "closed_s", "moving_s", "vehicle_moving"), "door_confidence", "gap", "door_motion", "scene_motion", "closed_s", "moving_s")


@query
def signature_statistics(spark, d):
    rows = X.door_frames(spark, d).withColumn("even", smart_stop.normalised(F.col("street")))
    return rows.select("session_id", "frame_index", F.round(F.get("even", 0), 6).alias("first"), F.round(F.get("even", 3), 6).alias("last"))


@query
def frame_diagnostics(spark, d):
    rows = detections.diagnostics(_labelled(spark, d), 30)
    return rows.select("session_id", "frame_index", F.coalesce(F.col("zones")["INSIDE"], F.lit(0)).alias("inside"), F.coalesce(F.col("zones")["OUTSIDE"], F.lit(0)).alias("outside"), "doorway", "detections")


def _clocked(spark, d) -> DataFrame:
    """Frames with a clock of 40 to 75 milliseconds a frame; none stops."""
    frames = X.detections(spark, d).groupBy("session_id", "frame_index").agg(F.count(F.lit(1)).alias("visible"))
    return frames.select("session_id", "frame_index", (F.col("frame_index") * 40 + F.col("frame_index") % 8 * 5).cast("long").alias("at_ms"), (F.col("frame_index") % 50 == 49).alias("stopped"), "visible")


@query
def emitted_frames(spark, d):
    return messages.emitted(_clocked(spark, d)).select("session_id", "frame_index", "sent")


@query
def emitted_long_clip(spark, d):
    """All order lines as one session, of thirty frames a line: its clock is one chain of more than a million frames at sf0.01."""
    frame = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 30 + F.col("k")
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    stops = (F.col("k") == 29) & (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 100 == 0)
    clock = rows.select(F.lit("long").alias("session_id"), frame.alias("frame_index"), (frame * 40 + frame % 8 * 5).alias("at_ms"), stops.alias("stopped"))
    return messages.emitted(clock).select("frame_index", "sent")


@query
def frame_messages(spark, d):
    boxes = X.detections(spark, d)
    events = boxes.where("det_seq = 2").select("session_id", "frame_index", F.col("det_seq").alias("track_id"))
    rows = messages.frame_messages(_clocked(spark, d), boxes.select("session_id", "frame_index", "det_seq", "x1"), events)
    shown = F.from_json("payload", "frame_index int, detections array<struct<det_seq int>>, visible int")
    return rows.withColumn("p", shown).select("session_id", "frame_index", "n_events", F.size("p.detections").alias("boxes"), F.col("p.visible").alias("visible"))


def _sessions(spark, d) -> DataFrame:
    """Stored results as sessions, some still running, some of those asked to stop."""
    rows = X.stored_results(spark, d)
    running = F.col("finished_ms") % 4 == 0
    return rows.select(
        "session_id", F.lit("v").alias("video_path"), F.when(running, "RUNNING").otherwise(F.col("status")).alias("status"), (F.col("finished_ms") - 5000).alias("started_ms"), F.when(~running, F.col("finished_ms")).alias("finished_ms"),
        (F.col("finished_ms") % 8 == 0).alias("stop_asked"), F.lit(9).cast("long").alias("frames_processed"), F.col("alightings").cast("long").alias("total_alightings"), F.lit(3).cast("long").alias("initial_onboard"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("finish_reason"),
    )


@query
def finished_sessions(spark, d):
    ends = X.stored_results(spark, d).select("session_id", F.when(F.col("finished_ms") % 3 == 0, "END_OF_FILE").when(F.col("finished_ms") % 3 == 1, "SMART_STOP").otherwise("ERROR").alias("ended_by"), F.col("finished_ms").alias("at_ms"), F.lit("r").alias("finish_reason"), F.lit(None).cast("string").alias("error_message"))
    return sessions.finish(_sessions(spark, d), ends).select("session_id", "status", "finished_ms", "finish_reason")


@query
def final_messages(spark, d):
    shown = F.from_json("payload", "status string, total_exited long, final_onboard long, duration_ms long")
    return messages.final_messages(_sessions(spark, d)).select("session_id", shown.alias("p")).select("session_id", "p.*")


@query
def session_state(spark, d):
    return sessions.state(_sessions(spark, d), "r1").select("session_id", "status", "total_exited", "current_onboard")


@query
def pending_doors(spark, d):
    samples = X.table(spark, d, "supplier").select(F.concat(F.lit("rec"), (F.col("s_suppkey") % 30).cast("string")).alias("recorder_id"), (F.col("s_suppkey") % 7).cast("string").alias("camera_code"), F.format_string("f%06d", "s_suppkey").alias("path"), (F.col("s_suppkey") % 50).alias("modified_ms"))
    return door_config.pending_channels(X.bindings(spark, d), samples).select("id", "recorder_id", "camera_code", "sample_path", "preview_available", "updated_ms")


@query
def completed_uploads(spark, d):
    k = F.col("o_orderkey")
    argument = F.when(k % 6 == 0, F.concat(F.lit("/1001/"), k.cast("string"))).when(k % 6 == 1, F.concat(F.lit('"a\\'), k.cast("string"), F.lit('"'))).when(k % 6 == 2, F.concat(F.lit("../../x/"), k.cast("string"))).when(k % 6 == 3, "  ").otherwise(F.concat(F.lit("../b/"), k.cast("string")))
    events = X.table(spark, d, "orders").select(argument.alias("argument"), F.when(k % 2 == 0, "/cam/").alias("working_dir"))
    return files.completed_uploads(events, "/data/incoming").select("path")


@query
def stop_points(spark, d):
    return smart_stop.stop_points(X.door_frames(spark, d), STOP)


@query
def analysed_frames(spark, d):
    frames = X.door_frames(spark, d)
    kept = smart_stop.until_stop(frames, smart_stop.stop_points(frames, STOP))
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.max("frame_index").alias("last_frame"))


@query
def live_exits(spark, d):
    return tracker.live_exits(X.walkers(spark, d), X.frame_zones(spark, d), TRACK, COUNT)


@query
def two_pass_results(spark, d):
    return two_pass.analyse(X.walkers(spark, d), X.frame_zones(spark, d), TRACK, COUNT, FATE)


def queries() -> dict[str, Query]:
    return dict(_found)
