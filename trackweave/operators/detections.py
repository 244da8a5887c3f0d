"""Per-frame operators on detections: raw rows to boxes, reshaping by detector mode, suppression, matching candidates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BoxConfig, DetectorConfig, TrackConfig
from ..functions import geometry as G
from ..functions.binding import let

FRAME = ["session_id", "frame_index"]


def sampled(frames: DataFrame, skip: int) -> DataFrame:
    """Every (skip + 1)th frame by index. The clip source takes the stride as an option; on other sources this filters after the scan."""
    return frames.where(F.col("frame_index") % (max(skip, 0) + 1) == 0)


def first_frame_from(frames: DataFrame, index: int) -> DataFrame:
    return frames.where(F.col("frame_index") >= index).orderBy("frame_index").limit(1)


def stream_info(frames: DataFrame, default_fps: float = 25.0) -> DataFrame:
    """fps, frames and seconds of each session; frame rates that are null or not above 0 count as the default."""
    info = frames.groupBy("session_id").agg(F.max("fps").alias("_fps"), (F.max("frame_index") + 1).alias("est_frames"))
    fps = F.when(F.col("_fps") > 0, F.col("_fps")).otherwise(default_fps)
    return info.select("session_id", fps.alias("fps"), "est_frames", (F.col("est_frames") / fps).alias("duration_s"))


def _in_frame(corners: Column, cfg: DetectorConfig, fw: Column, fh: Column) -> Column:
    """A box (an array of corners) of the square detector input, in pixels or as shares of its side, in the frame; null if it has no area."""
    side = F.lit(float(cfg.input_size))
    hold = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))

    def placed(c: Column, gain: Column) -> Column:
        pads = (side - fw * gain) / 2, (side - fh * gain) / 2
        return F.array(*[(c[k] - pads[k % 2]) / gain for k in range(4)])

    def held(c: Column) -> Column:
        return F.when((c[2] > c[0]) & (c[3] > c[1]), G.box(hold(c[0], fw), hold(c[1], fh), hold(c[2], fw), hold(c[3], fh)))

    scaled = _in_pixels(corners, cfg)
    return let(scaled, lambda c: let(F.least(side / fw, side / fh), lambda gain: let(placed(c, gain), held)))


def _in_pixels(values: Column, cfg: DetectorConfig) -> Column:
    """Values that are all shares of the input's side are scaled by it."""
    shares = F.forall(values, lambda v: v.between(-0.05, 1.5))
    return F.when(shares, F.transform(values, lambda v: v * float(cfg.input_size))).otherwise(values)


def _more_like_a_head(a: Column, b: Column, fw: Column, fh: Column) -> Column:
    """Whether box ``a`` is a likelier head than ``b``: where one fills much of the frame, the smaller; else by the ratio of its sides."""
    area = lambda x: G.width(x) * G.height(x) / (fw * fh)
    square = lambda x: (G.width(x) / F.greatest(G.height(x), F.lit(1.0))).between(0.45, 1.8)
    return F.when((area(b) > 0.18) & (area(a) < area(b)), True).when((area(a) > 0.18) & (area(b) < area(a)), False).otherwise(square(a) & ~square(b))


def parse_row(values: Column, cfg: DetectorConfig, frame_width: Column, frame_height: Column, least: float = 2.0) -> Column:
    """A detector's output row as a struct of box (in the frame), score and class; null if it is no detection.

    Null are rows of fewer than five values, boxes with a side under ``least`` pixels, and scores below the threshold. ``batch-class-xyxy`` rows
    have six values and score 1. ``auto`` takes rows that begin with two whole numbers before ordered corners for those, and
    reads others both ways, by corners and by centre: the one that is a box, or the likelier head, counts.
    """
    fw, fh = frame_width, frame_height
    form = cfg.form.lower()

    def read(v: Column) -> Column:
        whole = lambda x: F.abs(x - F.round(x)) < 1e-3
        batch = F.when(F.size(v) >= 6, _in_frame(F.slice(v, 3, 4), cfg, fw, fh))
        corners = _in_frame(F.slice(v, 1, 4), cfg, fw, fh)
        centre = let(_in_pixels(F.slice(v, 1, 4), cfg), lambda c: _in_frame(F.array(c[0] - c[2] / 2, c[1] - c[3] / 2, c[0] + c[2] / 2, c[1] + c[3] / 2), cfg, fw, fh))
        either = lambda c, m: F.when(c.isNull(), m).when(m.isNull(), c).when(_more_like_a_head(m, c, fw, fh), m).otherwise(c)
        is_batch = whole(v[0]) & whole(v[1]) & (F.get(v, 4) > v[2]) & (F.get(v, 5) > v[3])
        auto = F.when(is_batch, batch).otherwise(let(corners, lambda c: let(centre, lambda m: either(c, m))))
        forms = {"batch-class-xyxy": batch, "xyxy-score-class": corners, "xywh-score-class": centre, "cxcywh-score-class": centre}
        first = {"batch-class-xyxy": F.lit(True)}.get(form, F.lit(False) if form in forms else F.coalesce(is_batch, F.lit(False)))
        score = F.when(first, 1.0).otherwise(F.least(F.greatest(F.get(v, 4), F.lit(0.0)), F.lit(1.0)))
        kind = F.when(first, F.get(v, 1)).otherwise(F.get(v, 5)).cast("int")
        fits = lambda b: b.isNotNull() & (score >= cfg.threshold) & (G.width(b) >= least) & (G.height(b) >= least)
        return let(forms.get(form, auto), lambda b: F.when(fits(b), F.struct(b.alias("box"), score.alias("score"), kind.alias("kind"))))

    return F.when(F.size(values) >= 5, let(values.cast("array<double>"), read))


def is_planes(output: Column) -> Column:
    """Whether a detector's output is one row a coordinate or class, each long, instead of one row a detection."""
    return F.size(output).between(5, 16) & (F.size(F.get(output, 0)) > F.size(output) * 10)


def parse_output(outputs: DataFrame, cfg: DetectorConfig) -> DataFrame:
    """Detections of outputs (session_id, frame_index, frame_width, frame_height, output: arrays of numbers): det_seq, box, score, kind.

    Planes hold centre x, centre y, width, height, and scores by class, of which the best counts, and boxes of any size; other outputs are rows.
    """
    out = F.col("output")
    best = lambda i: F.array_max(F.transform(F.slice(out, 5, F.size(out) - 4), lambda plane: F.get(plane, i)))
    turned = F.transform(F.sequence(F.lit(0), F.size(F.get(out, 0)) - 1), lambda i: F.array(*[F.get(F.get(out, k), i) for k in range(4)], best(i)))
    planes = outputs.withColumn("planes", is_planes(out))
    rows = planes.select(*FRAME, "frame_width", "frame_height", "planes", F.posexplode(F.when(F.col("planes"), turned).otherwise(out)).alias("det_seq", "_row"))
    fw, fh = F.col("frame_width"), F.col("frame_height")
    by_plane = parse_row(F.col("_row"), replace(cfg, form="xywh-score-class"), fw, fh, 0.0)
    found = rows.withColumn("_found", F.when(F.col("planes"), by_plane).otherwise(parse_row(F.col("_row"), cfg, fw, fh))).where("_found is not null")
    return found.select(*FRAME, "det_seq", "_found.box", "_found.score", "_found.kind")


def plane_scores(planes: DataFrame) -> DataFrame:
    """Detector planes, one row with an array for each of x, y, w, h and the classes, as one row per anchor: box, best class and score."""
    zipped = F.posexplode(F.arrays_zip("cx", "cy", "w", "h"))
    rows = planes.select(*FRAME, "scores", zipped.alias("anchor", "b"))
    each = F.transform("scores", lambda plane: F.get(plane, F.col("anchor")))
    rows = rows.withColumn("_each", each).withColumn("score", F.array_max("_each"))
    corner = G.box(F.col("b.cx") - F.col("b.w") / 2, F.col("b.cy") - F.col("b.h") / 2, F.col("b.cx") + F.col("b.w") / 2, F.col("b.cy") + F.col("b.h") / 2)
    return rows.select(*FRAME, "anchor", corner.alias("box"), "score", (F.array_position("_each", F.col("score")) - 1).cast("int").alias("kind"))


def scored_persons(rows: DataFrame, threshold: float, person: int = 0) -> DataFrame:
    """Rows whose score reaches the threshold and whose best class is a person."""
    return rows.where((F.col("score") >= threshold) & (F.col("kind") == person))


def tracking_boxes(rows: DataFrame, mode: str, cfg: BoxConfig) -> DataFrame:
    """Adds ``head`` and ``body`` to rows with box, frame_width, frame_height.

    ``person``: the head is cut out of the box. ``head``: a body is made below the box, masked boxes go, and a box too
    large for a head is taken for a body. ``whole``: the box serves as both.
    """
    b, fw, fh = F.col("box"), F.col("frame_width"), F.col("frame_height")
    if mode == "person":
        return rows.withColumn("head", G.head_region(b, fw, fh, cfg)).withColumn("body", b)
    if mode == "whole":
        return rows.withColumn("head", b).withColumn("body", b)
    large = G.too_large_for_head(b, fw, fh, cfg)
    kept = rows.where(~G.in_corner_mask(b, fw, fh, cfg))
    return kept.withColumn("head", F.when(large, G.head_region(b, fw, fh, cfg)).otherwise(b)).withColumn("body", F.when(large, b).otherwise(G.synthetic_body(b, fw, fh, cfg)))


def suppress_overlaps(rows: DataFrame, max_iou: float) -> DataFrame:
    """Non-max suppression in each frame: the best box stays, boxes that overlap it by more go, and so on.

    Order-dependent, so a fold over each frame's boxes, inside the JVM; ties in confidence keep det_seq order.
    """
    place = F.struct((-F.col("confidence")).alias("by"), "det_seq", *[F.col(c) for c in rows.columns if c != "det_seq" and c not in FRAME])
    best_first = rows.groupBy(*FRAME).agg(F.array_sort(F.collect_list(place), _by("by", "det_seq")).alias("_boxes"))
    kind = best_first.schema["_boxes"].dataType
    kept = F.aggregate("_boxes", F.array().cast(kind), lambda done, b: F.when(F.forall(done, lambda k: G.iou(k, b) <= max_iou), F.array_append(done, b)).otherwise(done))
    return best_first.select(*FRAME, F.explode(kept).alias("_b")).select(*[F.col(c) if c in FRAME else F.col(f"_b.{c}") for c in rows.columns])


def _by(*names: str):
    """A comparison of structs by some of their fields, each ascending."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for n in reversed(names):
            out = F.when(a[n] < b[n], -1).when(a[n] > b[n], 1).otherwise(out)
        return out

    return compare


def overlap_candidates(tracks: DataFrame, boxes: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Track and detection pairs of a frame that overlap enough. Equal session and frame keep the join local."""
    pairs = tracks.join(boxes, FRAME)
    pairs = pairs.withColumn("iou", G.iou(F.col("box"), F.col("track_box"))).withColumn("center_px", G.center_distance(F.col("box"), F.col("track_box")))
    return pairs.where(F.col("iou") >= cfg.min_iou)


def center_limit(a: Column, b: Column, cfg: TrackConfig) -> Column:
    longest = F.greatest(G.width(a), G.height(a), G.width(b), G.height(b))
    return F.least(F.lit(cfg.center_px), longest * max(cfg.center_size_factor, 0.5))


def center_candidates(tracks: DataFrame, boxes: DataFrame, taken: DataFrame, cfg: TrackConfig) -> DataFrame:
    """Of tracks and detections that no overlap pair took, pairs whose centres are close enough for their size."""
    free_tracks = tracks.join(taken.select(*FRAME, "track_id").distinct(), [*FRAME, "track_id"], "left_anti")
    free_boxes = boxes.join(taken.select(*FRAME, "det_seq").distinct(), [*FRAME, "det_seq"], "left_anti")
    pairs = free_tracks.join(free_boxes, FRAME)
    pairs = pairs.withColumn("iou", G.iou(F.col("box"), F.col("track_box"))).withColumn("center_px", G.center_distance(F.col("box"), F.col("track_box")))
    return pairs.where(F.col("center_px") <= center_limit(F.col("box"), F.col("track_box"), cfg))


def greedy(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one pairs of each frame, taken greedily in the order of ``by`` (a minus sign for descending), then track and detection.

    A fold over each frame's candidates, inside the JVM: the first of those that are left is taken, and all that share its track or its detection go.
    """
    order = [(-F.col(b[1:]) if b.startswith("-") else F.col(b)).alias(f"_{k}") for k, b in enumerate(by)]
    one = F.struct(*order, "track_id", "det_seq", "iou", "center_px")
    frames = candidates.groupBy(*FRAME).agg(F.array_sort(F.collect_list(one)).alias("_left"))
    kind = frames.schema["_left"].dataType
    turns = F.sequence(F.lit(1), F.least(F.size(F.array_distinct(F.transform("_left", lambda c: c["track_id"]))), F.size(F.array_distinct(F.transform("_left", lambda c: c["det_seq"])))))
    start = F.struct(F.col("_left").alias("left"), F.array().cast(kind).alias("taken"))

    def turn(state: Column, _: Column) -> Column:
        rest = lambda first: F.filter(state["left"], lambda c: (c["track_id"] != first["track_id"]) & (c["det_seq"] != first["det_seq"]))
        step = let(F.get(state["left"], 0), lambda first: F.struct(rest(first).alias("left"), F.array_append(state["taken"], first).alias("taken")))
        return F.when(F.size(state["left"]) > 0, step).otherwise(state)

    taken = F.aggregate(turns, start, turn)["taken"]
    return frames.select(*FRAME, F.explode(taken).alias("_p")).select(*FRAME, "_p.track_id", "_p.det_seq", "_p.iou", "_p.center_px")


def diagnostics(labelled: DataFrame, every: int = 30) -> DataFrame:
    """Of every ``every``th frame: its detections by zone (as a map), in the doorway, and altogether."""
    some = labelled.where(F.col("frame_index") % max(every, 1) == 0)
    by_zone = some.groupBy(*FRAME, "zone").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_door").alias("doorway"))
    zones = F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", "n"))))
    return by_zone.groupBy(*FRAME).agg(zones.alias("zones"), F.sum("doorway").alias("doorway"), F.sum("n").alias("detections"))


def zone_counts(labelled: DataFrame) -> DataFrame:
    """Detections of each frame by zone, and those in the doorway, which overlaps the zones."""
    return labelled.groupBy(*FRAME).agg(*[F.count_if(F.col("zone") == z).alias(n) for z, n in (("INSIDE", "inside"), ("OUTSIDE", "outside"), ("BUFFER", "buffer"))], F.count_if("in_door").alias("doorway"))
