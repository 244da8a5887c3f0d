"""Geometry, vectors and paths against plain Python."""

import math
import random

from pyspark.sql import functions as F

from trackweave.config import BoxConfig
from trackweave.fixtures import polygon
from trackweave.functions import geometry as G
from trackweave.functions import paths as P
from trackweave.functions import vectors as V
from trackweave.operators.tracker import inside


def test_point_in_polygon_matches_python_on_a_grid(spark):
    shapes = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (9, 2), (5, 9)], [(0, 0), (8, 0), (8, 8), (4, 3), (0, 8)], [(1, 1), (2, 2)]]
    grid = spark.createDataFrame([(x / 2, y / 2) for x in range(-1, 22) for y in range(-1, 22)], "x double, y double")
    for shape in shapes:
        shape = [(float(x), float(y)) for x, y in shape]
        for r in grid.withColumn("held", G.point_in_polygon(F.col("x"), F.col("y"), polygon(shape))).collect():
            assert r.held == inside(r.x, r.y, shape), (r, shape)


def test_edges_are_half_open(spark):
    square = polygon([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (10.0, 5.0), (10.0, 10.0)], "x double, y double")
    assert [r.h for r in rows.select(G.point_in_polygon(F.col("x"), F.col("y"), square).alias("h")).collect()] == [True, True, False, False]


def test_zones_from_a_line_halve_the_frame(spark):
    zones = G.zones_from_line((0.0, 0.5), (1.0, 0.5), 1000.0, 1000.0)
    assert sorted(zones["salon"]) == [(0.0, 0.5), (0.0, 1.0), (1.0, 0.5), (1.0, 1.0)]
    assert sorted(zones["street"]) == [(0.0, 0.0), (0.0, 0.5), (1.0, 0.0), (1.0, 0.5)]
    # 35 % of a line of 1000 pixels is held to 28 % of the frame; 22 % of its height.
    assert [(round(x, 3), round(y, 3)) for x, y in zones["door"]] == [(0.36, 0.39), (0.64, 0.39), (0.64, 0.61), (0.36, 0.61)]
    assert G.default_door((0.0, 100.0), (10.0, 100.0), 200.0, 200.0) == [(0.0, 55.0), (13.0, 55.0), (13.0, 145.0), (0.0, 145.0)]
    upside = G.zones_from_line((1.0, 0.5), (0.0, 0.5), 1000.0, 1000.0, inside_below=False)
    assert sorted(upside["salon"]) == sorted(zones["street"])


def test_a_door_is_that_of_the_frame_in_pixels(spark):
    a, b = (0.46, 0.12), (0.18, 0.88)
    door = G.zones_from_line(a, b, 640.0, 480.0)["door"]
    # The line is 406.4 px long; 35 % of it is 142.2 px. 22 % of the height is 105.6 px.
    assert [(round(x, 3), round(y, 3)) for x, y in door] == [(0.209, 0.39), (0.431, 0.39), (0.431, 0.61), (0.209, 0.61)]
    lines = [(*a, *b, 640, 480), (0.0, 0.0, 0.01, 0.0, 352, 288), (-0.2, 0.5, 1.4, 0.9, 1280, 720), (0.97, 0.9, 1.0, 1.0, 320, 100)]
    frame = spark.createDataFrame(lines, "ax double, ay double, bx double, by double, w int, h int")
    found = frame.select("*", G.line_door(*[F.col(c) for c in frame.columns]).alias("d")).collect()
    for r in found:
        want = G.zones_from_line((r.ax, r.ay), (r.bx, r.by), float(r.w), float(r.h))["door"]
        assert [round(v, 9) for v in r.d] == [round(v, 9) for v in (*want[0], *want[2])]


def test_boxes(spark):
    b = lambda *v: G.box(*[F.lit(float(x)) for x in v])
    cfg = BoxConfig()
    r = spark.range(1).select(
        G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)).alias("iou"), G.iou(b(0, 0, 1, 1), b(5, 5, 6, 6)).alias("none"), G.center_distance(b(0, 0, 2, 2), b(3, 4, 5, 6)).alias("px"),
        G.head_region(b(100, 100, 200, 400), F.lit(640), F.lit(480), cfg).alias("head"), G.synthetic_body(b(300, 400, 340, 440), F.lit(640), F.lit(480), cfg).alias("body"),
        G.in_corner_mask(b(0, 0, 40, 40), F.lit(640), F.lit(480), cfg).alias("masked"), G.upscale(F.lit(640), F.lit(360)).alias("up"),
    ).first()
    assert math.isclose(r.iou, 1 / 3) and r.none == 0 and r.px == 5 and r.masked and math.isclose(r.up, 480 / 360)
    assert (r.head.x1, r.head.y1, r.head.x2, r.head.y2) == (117.5, 100.0, 182.5, 184.0)
    assert (r.body.x1, r.body.y1, r.body.x2, r.body.y2) == (264.0, 400.0, 376.0, 480.0)


def test_polygons_are_held_within_the_frame(spark):
    rows = spark.createDataFrame([('[{"x":-1,"y":0.5},{"x":2,"y":0},{"x":0.1,"y":0.2}]',), ('[{"x":1,"y":1}]',), ("bad",), (None,)], "t string")
    found = [r.p for r in rows.select(G.clean_polygon(P.points_from_json(F.col("t"))).alias("p")).collect()]
    assert [(p.x, p.y) for p in found[0]] == [(0.0, 0.5), (1.0, 0.0), (0.1, 0.2)] and found[1:] == [[], [], []]


def test_vectors(spark):
    rng = random.Random(2)
    a, b = [rng.random() for _ in range(8)], [rng.random() for _ in range(8)]
    row = spark.createDataFrame([(a, b, a[:3])], "a array<double>, b array<double>, c array<double>")
    r = row.select(V.dot(F.col("a"), F.col("b")).alias("dot"), V.dot(F.col("a"), F.col("c")).alias("odd"), V.normalise(F.col("a")).alias("unit"), V.blend(F.lit(None).cast("array<double>"), F.col("b")).alias("one")).first()
    assert math.isclose(r.dot, sum(x * y for x, y in zip(a, b, strict=True))) and r.odd == 0 and r.one == b
    assert math.isclose(sum(x * x for x in r.unit), 1.0)


def test_path_metadata(spark):
    rows = spark.createDataFrame(
        [("/x/12/2024-05-01/3_E7_1_1714521600_1714521660_0_99.mp4",), ("C:\\v\\77\\2024-01-02\\cam__x.mp4",), ("/12/videos/a.mp4",), ("/9/2024-99-99/1_a.mp4",), ("solo.mp4",)], "path string"
    )
    found = rows.withColumns(P.video_metadata(F.col("path"))).collect()
    r = found[0]
    assert (r.video_device_id, str(r.record_date), r.channel, r.camera_code, r.event_code, r.record_type, r.file_flag, r.file_uid) == ("12", "2024-05-01", 3, "3", "E7", 1, 0, 99)
    assert r.relative_path == "12/2024-05-01/3_E7_1_1714521600_1714521660_0_99.mp4" and (r.clip_finished_at - r.clip_started_at).seconds == 60
    assert (found[1].video_device_id, found[1].channel, found[1].event_code) == ("77", None, None)
    assert found[2].video_device_id is None and found[2].relative_path is None
    assert (found[3].video_device_id, found[3].record_date) == ("9", None) and found[4].channel is None


def test_names_and_clock(spark):
    row = spark.range(1).select(
        P.safe_segment(F.lit(" a/b c ")).alias("a"), P.safe_segment(F.lit("  ")).alias("b"), P.extension(F.lit("/x.y/Clip.MP4")).alias("c"), P.clock_text(F.lit(3000), F.lit(25.0)).alias("d"), P.clock_text(F.lit(50), F.lit(0.0)).alias("e"),
    ).first()
    assert tuple(row) == ("a_b_c", "unknown", "mp4", "02:00", "00:02")


def test_position_fallback_takes_all_boxes(spark, tmp_path):
    from trackweave import fixtures, queries

    spark.range(700).selectExpr("id AS event_id", "id * 10 AS ts").write.parquet(f"{tmp_path}/events.parquet")
    cfg, right = queries.TRACK, {}
    rows = fixtures.detections(spark, str(tmp_path)).collect()
    middle = lambda r: ((r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2)
    sides = lambda r: (r.x2 - r.x1, r.y2 - r.y1)
    for a in rows:
        for b in rows:
            fit = b.frame_index % 30 <= cfg.fallback_lost and b.det_seq != 1 and b.frame_index % 7 != 0
            if a.session_id == b.session_id and a.frame_index == b.frame_index + 1 and middle(a)[1] < 300 and fit:
                px = math.dist(middle(a), middle(b))
                if px <= min(250, 2 * min(90, 2.6 * max(*sides(a), *sides(b)))):
                    key, value = (a.session_id, a.frame_index, a.det_seq), (px, b.det_seq)
                    right[key] = min(right.get(key, value), value)
    found = {(r.session_id, r.frame_index, r.det_seq): (r.px, r.track_id) for r in queries.position_fallback(spark, str(tmp_path)).collect()}
    assert len(found) > 100 and found == {k: (round(px, 6), i) for k, (px, i) in right.items()}


def test_locations_follow_roots_and_first_folders(spark):
    rows = [("FTP_INCOMING", "12/x.mp4", "FTP_INCOMING"), ("FTP_PROCESSED", "finished/x.mp4", "FTP_FINISHED"), ("FTP_PROCESSED", "Needs-Classification/x.mp4", "FTP_NEEDS_CLASSIFICATION"), ("FTP_PROCESSED", "12/failed/x.mp4", "FTP_PROCESSED"), ("VIDEOS", "classification/x.mp4", "CHANNEL_PREVIEW"), ("VIDEOS", "x.mp4", "MANUAL"), ("NONE", "x", None)]
    found = spark.createDataFrame(rows, "kind string, below string, want string").withColumn("got", P.storage_location(F.col("kind"), F.col("below"))).collect()
    assert all(r.got == r.want for r in found)
    flags = spark.range(1).select(P.location_flag(F.lit("CHANNEL_PREVIEW"), 1).alias("a"), P.location_flag(F.lit("CHANNEL_PREVIEW"), 2).alias("b"), P.location_flag(F.lit("FTP_INCOMING"), 1).alias("c"), P.file_time(F.lit(1_714_564_800_000)).alias("t")).first()
    assert tuple(flags) == (True, False, False, "01.05.24 12:00")


def test_paths_that_escape_home_are_told(spark):
    rows = {"/h/in/a.mp4": True, "/h/in/x/../a.mp4": True, "/h/in/../out/a.mp4": False, "/h/inner/a.mp4": False, "/h/in": False, "/../../h/in/a": False}
    found = spark.createDataFrame([(k,) for k in rows], "p string").withColumn("ok", P.inside_home(F.col("p"), "/h/in")).collect()
    assert {r.p: r.ok for r in found} == rows
    layout = {"/v/12/2024-05-01/a.mp4": True, "/v/12/2024-05-01/x/a.mp4": True, "/v/12/2024-05-01": False, "/v/12/2024-13-01/a.mp4": False, "/v/a1/2024-05-01/a.mp4": False, "/v/12/2024-05-01/Processed/a.mp4": False}
    found = spark.createDataFrame([(k,) for k in layout], "p string").withColumn("ok", P.in_device_layout(F.col("p"), "/v")).collect()
    assert {r.p: r.ok for r in found} == layout


def test_polygons_are_written_as_they_are_read(spark):
    rows = spark.createDataFrame([('[{"x":-1,"y":0.5},{"x":2,"y":0}]',), (None,)], "t string").select(P.points_to_json(P.points_from_json(F.col("t"))).alias("t"))
    assert [r.t for r in rows.collect()] == ['[{"x":0.0,"y":0.5},{"x":1.0,"y":0.0}]', "[]"]


def placed(corners, cfg, w, h):
    if all(-0.05 <= c <= 1.5 for c in corners):
        corners = [c * cfg.input_size for c in corners]
    gain = min(cfg.input_size / w, cfg.input_size / h)
    pads = (cfg.input_size - w * gain) / 2, (cfg.input_size - h * gain) / 2
    x1, y1, x2, y2 = ((c - pads[k % 2]) / gain for k, c in enumerate(corners))
    if x2 <= x1 or y2 <= y1:
        return None
    return tuple(min(max(v, 0.0), float(m)) for v, m in zip((x1, y1, x2, y2), (w, h, w, h), strict=True))


def by_hand(row, cfg, w, h):
    """A detector's row read by plain Python."""
    if len(row) < 5:
        return None
    centre = list(row[:4])
    if all(-0.05 <= c <= 1.5 for c in centre):
        centre = [c * cfg.input_size for c in centre]
    middle = placed([centre[0] - centre[2] / 2, centre[1] - centre[3] / 2, centre[0] + centre[2] / 2, centre[1] + centre[3] / 2], cfg, w, h)
    corners, batch = placed(row[:4], cfg, w, h), placed(row[2:6], cfg, w, h) if len(row) >= 6 else None
    score = row[4]
    if cfg.form == "batch-class-xyxy":
        box, score = batch, 1.0
    elif cfg.form == "xyxy-score-class":
        box = corners
    elif cfg.form == "xywh-score-class":
        box = middle
    elif all(abs(v - round(v)) < 1e-3 for v in row[:2]) and row[4] > row[2] and len(row) > 5 and row[5] > row[3]:
        box, score = batch, 1.0
    elif corners is None or middle is None:
        box = corners or middle
    else:
        area = lambda b: (b[2] - b[0]) * (b[3] - b[1]) / (w * h)
        square = lambda b: 0.45 <= (b[2] - b[0]) / max(b[3] - b[1], 1.0) <= 1.8
        if area(corners) > 0.18 and area(middle) < area(corners):
            box = middle
        elif area(middle) > 0.18 and area(corners) < area(middle):
            box = corners
        else:
            box = middle if square(middle) and not square(corners) else corners
    score = min(max(score, 0.0), 1.0)
    return None if box is None or score < cfg.threshold or box[2] - box[0] < 2 or box[3] - box[1] < 2 else (*[round(v, 6) for v in box], score)


def test_detector_rows_match_plain_python(spark):
    from trackweave.config import DetectorConfig
    from trackweave.operators import detections

    rng = random.Random(5)
    rows = []
    for k in range(400):
        big = rng.choice([1.0, 640.0])
        row = [rng.random() * big for _ in range(4)] + [rng.random(), 0.0]
        if k % 5 == 0:
            row = [0.0, 1.0, rng.random() * 300, rng.random() * 300, 300 + rng.random() * 300, 300 + rng.random() * 300]
        rows.append(row[: rng.choice([3, 5, 6, 6, 6])])
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v array<double>").repartition(2)
    for form in ("auto", "batch-class-xyxy", "xyxy-score-class", "xywh-score-class"):
        cfg = DetectorConfig(form=form, threshold=0.3)
        found = frame.withColumn("r", detections.parse_row(F.col("v"), cfg, F.lit(640), F.lit(360))).collect()
        for r in found:
            got = None if r.r is None else (*[round(x, 6) for x in r.r.box], r.r.score)
            assert got == by_hand(rows[r.k], cfg, 640, 360), (form, rows[r.k])


def test_planes_are_told_from_rows(spark):
    from trackweave.operators import detections

    shapes = [(5, 51, True), (5, 50, False), (4, 900, False), (16, 161, True), (17, 900, False), (60, 6, False)]
    frame = spark.createDataFrame([(a, b, want, [[0.0] * b] * a) for a, b, want in shapes], "a int, b int, want boolean, v array<array<double>>")
    assert all(r.got == r.want for r in frame.withColumn("got", detections.is_planes(F.col("v"))).select("got", "want").collect())


def test_planes_keep_small_boxes_and_rows_do_not(spark):
    from trackweave.config import DetectorConfig
    from trackweave.operators import detections

    n = 60
    planes = [[100.0 + 5 * i for i in range(n)], [200.0] * n, [1.0] * n, [1.5] * n, [0.9] + [0.1] * (n - 1)]
    lines = [[100.0, 200.0, 101.0, 201.5, 0.9, 0.0], [100.0, 200.0, 110.0, 215.0, 0.9, 0.0]]
    outputs = spark.createDataFrame([("a", 0, 640, 640, planes), ("b", 0, 640, 640, lines)], "session_id string, frame_index int, frame_width int, frame_height int, output array<array<double>>")
    found = detections.parse_output(outputs, DetectorConfig(form="xyxy-score-class")).collect()
    assert sorted((r.session_id, r.det_seq, round(r.box.x2 - r.box.x1, 6)) for r in found) == [("a", 0, 1.0), ("b", 1, 10.0)]


def test_images():
    import numpy as np
    import pytest

    from trackweave.functions import images

    image = np.zeros((48, 48, 3), np.uint8)
    image[24:] = 255
    cells = images.grid_signature(image, [(0, 0), (1, 0), (1, 1), (0, 1)], 4)
    assert cells[:8] == [0.0] * 8 and cells[8:] == pytest.approx([1.0] * 8)
    assert images.grid_signature(image, [], 4) == [None] * 16
    assert images.grid_signature(image, [(-1, -1), (3, -1), (3, 3), (-1, 3)], 2) == images.grid_signature(image, [(-1, -1), (3, -1), (3, 3), (-1, 3)], 2)
    boxed = images.letterboxed(image[:24], 96)
    assert boxed.shape == (3, 96, 96) and boxed[0, 0, 0] == pytest.approx(114 / 255) and boxed[0, 48, 48] == 0
    assert images.crop(image, (0, 0, 5, 5)) is None and images.crop(image, (60, 60, 90, 90)) is None
    white = images.crop(image, (0, 26, 40, 46))
    assert white.shape == (3, 256, 128) and white[0].max() == pytest.approx((1 - 0.485) / 0.229, abs=1e-5)


def test_image_functions_run_on_tables(spark):
    from trackweave.functions import images
    from trackweave.operators.smart_stop import normalised

    raw = bytes([0, 0, 0] * 8 + [255, 255, 255] * 8)
    rows = spark.createDataFrame([(raw, 4, 4), (None, 4, 4)], "image binary, width int, height int")
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    found = rows.select(images.signature("image", "width", "height", square).alias("s"), images.letterbox_input("image", "width", "height", 8).alias("l")).collect()
    assert len(found[0].s) == 576 and len(found[0].l) == 192 and found[1].s is None and found[1].l is None
    even = rows.limit(1).select(images.signature("image", "width", "height", square).alias("s")).select(normalised(F.col("s")).alias("s")).first().s
    assert abs(sum(even)) < 1e-6 and min(even) < 0 < max(even)


def test_settings_come_from_texts():
    import pytest

    from trackweave.config import CountConfig, StopConfig, configured

    found = configured(StopConfig, {"PC_SMART_STOP_MIN_SECONDS": "3.5", "pc-smart-stop-need-activity": "no", "PC_SMART_STOP_CALIBRATION_SAMPLES": " 2 ", "PC_SMART_STOP_OPEN_MAX": ""}, "pc_smart_stop_")
    assert (found.min_seconds, found.need_activity, found.calibration_samples, found.open_max) == (3.5, False, 2, 0.10)
    assert configured(CountConfig, {"mode": "streaming"}).mode == "streaming" and configured(CountConfig, {}) == CountConfig()
    for bad in ({"stride": "x"}, {"allow_preboarded": "maybe"}):
        with pytest.raises(ValueError):
            configured(CountConfig, bad)
