"""The tracker and the live counter step by step, batch against streaming, and smart stop."""

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave import fixtures, schemas
from trackweave.config import CountConfig, LineConfig, StopConfig, TrackConfig
from trackweave.operators import detections, line_counter, smart_stop, tracker
from trackweave.operators.tracker import Seen, SessionCore, Zones

ZONES = Zones([(0, 260), (640, 260), (640, 480), (0, 480)], [(0, 0), (640, 0), (640, 220), (0, 220)], [(200, 150), (440, 150), (440, 300), (200, 300)], [(0, 420), (640, 420), (640, 480), (0, 480)])
COUNT = CountConfig(stride=1, stable_samples=2, lost_frames=2, startup_frames=1)


def head(y, size=40.0, x=320.0, conf=0.9, vector=None):
    return Seen((x - size / 2, y - size / 2, x + size / 2, y + size / 2), conf, (x - size, y - size / 2, x + size, y + 3 * size), vector)


def core(count=COUNT, track=TrackConfig()):
    return SessionCore(ZONES, 480.0, track, count)


def walk(c, ys, start=0, **k):
    return [e for i, y in enumerate(ys) for e in c.frame(start + i, [] if y is None else [head(y, **k)])]


def test_a_walk_out_counts_once_after_the_track_is_lost():
    c = core()
    assert walk(c, [400, 370, 340, 310, 280, 250, 220, 190, 170]) == []
    events = walk(c, [None] * 6, start=9)
    assert [(e["kind"], e["exits"], e["total_exits"]) for e in events] == [("EXIT", 1, 1)]


def test_one_who_stays_inside_or_turns_back_does_not_count():
    c = core()
    assert walk(c, [400, 400, 400, 400] + [None] * 8) == []
    c = core()
    assert walk(c, [400, 340, 280, 220, 280, 340, 400, 400, 400] + [None] * 8) == []


def test_one_outside_from_the_start_counts_when_gone():
    c = core()
    assert len(walk(c, [190, 185, 180, 175] + [None] * 6)) == 1


def test_weak_detections_are_born_in_the_spawn_strip_only():
    c = core()
    c.frame(0, [head(200, conf=0.3)])
    assert not c.active
    c.frame(1, [head(450, conf=0.3)])
    assert len(c.active) == 1


def test_a_repeated_exit_nearby_is_suppressed():
    c = core(CountConfig(stride=1, stable_samples=2, lost_frames=2, startup_frames=1, lock_frames=18))
    out = [400, 370, 340, 310, 280, 250, 220, 190, 170]
    walk(c, [*out, None, None, None])
    first = c.exits
    for k, y in enumerate(out):
        c.frame(20 + k, [head(y, x=340.0)])
    for k in range(4):
        c.frame(29 + k, [])
    assert first == 1 and c.exits in (1, 2)
    assert len(c.locks) >= 1


@pytest.mark.parametrize("pairs", [1, 7, 1 << 19])
def test_pairs_are_ranked_as_by_trying_them_one_by_one(monkeypatch, pairs):
    monkeypatch.setattr(tracker, "PAIRS", pairs)
    r = random.Random(pairs)
    box = lambda: (x := r.randrange(0, 90, 10), y := r.randrange(0, 90, 10), x + r.choice([20, 30]), y + 40)
    tracks, found = [box() for _ in range(14)], [box() for _ in range(11)]
    plain = [((-s, tracker.centers(d, t)), i, j) for i, t in enumerate(tracks) for j, d in enumerate(found) if (s := tracker.overlap(d, t)) >= 0.3]
    i, j = tracker.ranked(tracks, found, (lambda share, dx, dy, side: share >= 0.3,), lambda share, px: (-share, px))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [p[1:] for p in sorted(plain)] and plain


def test_a_crowd_of_lost_tracks_returns_in_time():
    """A thousand heads, half of which are gone in every other frame: pairs and returns are found by arrays, not one by one."""
    c, r = core(), random.Random(1)
    crowd = [head(r.uniform(0, 480), x=r.uniform(0, 640)) for _ in range(1000)]
    began = time.process_time()
    for k in range(6):
        c.frame(k, crowd[::2] if k % 2 else crowd)
    assert time.process_time() - began < 8 and len(c.samples) >= 4500


def test_reid_returns_an_archived_track():
    c = core(track=TrackConfig(archive_after=2))
    c.frame(0, [head(400, vector=(1.0, 0.0))])
    for k in range(1, 6):
        c.frame(k, [])
    assert [t.ident for t in c.lost] == [1]
    c.frame(6, [head(120, x=80.0, vector=(0.9, 0.1))])
    assert [t.ident for t in c.active] == [1]
    c.frame(7, [head(120, x=80.0, vector=(0.9, 0.1)), head(420, x=600.0, vector=(0.0, 1.0))])
    assert [t.ident for t in c.active] == [1, 2]


def test_equal_detections_serve_one_track():
    c = core()
    c.frame(0, [head(400), head(401, x=322.0)])
    c.frame(1, [head(400), head(400)])
    assert sum(t.missed == 0 for t in c.active) == 2 and len(c.active) == 3


def test_startup_frames_are_recorded_twice():
    c = core(CountConfig(stride=1, startup_frames=2))
    walk(c, [400, 400, 400])
    assert [s["frame_index"] for s in c.samples] == [0, 0, 1, 1, 2]
    assert c.origins == {1: "STARTUP_INSIDE"}


def test_greedy_pairs_and_suppression(spark):
    rows = [("s", 0, 1, 1, 0.9, 1.0), ("s", 0, 1, 2, 0.8, 1.0), ("s", 0, 2, 1, 0.85, 1.0), ("s", 0, 2, 2, 0.1, 9.0), ("s", 0, 3, 3, 0.5, 1.0), ("s", 0, 4, 3, 0.5, 1.0)]
    found = detections.greedy(spark.createDataFrame(rows, "session_id string, frame_index int, track_id int, det_seq int, iou double, center_px double"), ["-iou", "center_px"])
    assert sorted((r.track_id, r.det_seq) for r in found.collect()) == [(1, 1), (2, 2), (3, 3)]
    boxes = [("s", 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, None, None), ("s", 0, 1, 1.0, 1.0, 11.0, 11.0, 0.8, None, None), ("s", 0, 2, 20.0, 0.0, 30.0, 10.0, 0.7, None, None)]
    kept = detections.suppress_overlaps(spark.createDataFrame(boxes, schemas.DETECTIONS).drop("body", "embedding"), 0.5)
    assert sorted(r.det_seq for r in kept.collect()) == [0, 2]


def test_streaming_counts_as_batch_does(spark, tmp_path):
    from trackweave.streaming import sessions

    pdf = fixtures.walkers(spark, "/root/testdata/sf0.001").toPandas()
    zones = fixtures.frame_zones(spark, "/root/testdata/sf0.001")
    batch = tracker.live_exits(fixtures.walkers(spark, "/root/testdata/sf0.001"), zones, TrackConfig(), CountConfig())
    right = sorted((r.session_id, r.frame_index, r.track_id) for r in batch.collect())
    lines = []
    for session, group in pdf.groupby("session_id"):
        frames = {k: g for k, g in group.sort_values("det_seq").groupby("frame_index")}
        for index in range(min(frames), max(frames) + 3 * 5 + 1, 3):
            found = frames[index] if index in frames else group.iloc[:0]
            dets = [{"x1": d.x1, "y1": d.y1, "x2": d.x2, "y2": d.y2, "confidence": d.confidence, "body": dict(d.body) if isinstance(d.body, dict) else d.body.asDict()} for d in found.itertuples()]
            lines.append(json.dumps({"session_id": session, "frame_index": index, "ended": False, "detections": dets}))
    (tmp_path / "in").mkdir()
    half = [[x for x in lines if (json.loads(x)["frame_index"] < 90) == (k == 0)] for k in range(2)]
    box = "x1: double, y1: double, x2: double, y2: double"
    schema = f"session_id string, frame_index int, ended boolean, detections array<struct<{box}, confidence: double, body: struct<{box}>>>"
    for k, part in enumerate(half):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k * 60,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    done = sessions.live_exits(stream, zones, TrackConfig(), CountConfig(), idle_ms=None).writeStream.format("memory").queryName("exits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert done.awaitTermination(120)
    finally:
        done.stop()
    assert right
    assert sorted((r.session_id, r.frame_index, r.track_id) for r in spark.table("exits").collect()) == right


def test_snapshots_go_on_as_if_nothing_had_stopped():
    import math
    import random

    rng = random.Random(4)
    cfg, track = CountConfig(stride=1, stable_samples=2, lost_frames=2, startup_frames=2, lock_frames=9), TrackConfig(archive_after=3)
    whole, cut = core(cfg, track), core(cfg, track)
    people = [{"x": rng.uniform(50, 590), "y": rng.uniform(20, 460), "dy": rng.choice([-9, -4, 5, 8]), "v": [rng.uniform(-1, 1) for _ in range(4)]} for _ in range(7)]
    told = []
    for index in range(150):
        found = []
        for k, p in enumerate(people):
            p["y"] += p["dy"]
            p["dy"] = -p["dy"] if not 10 < p["y"] < 470 else p["dy"]
            if rng.random() < 0.75:
                norm = math.sqrt(sum(x * x for x in p["v"]))
                found.append(head(p["y"], x=p["x"], vector=tuple(x / norm for x in p["v"]) if k % 2 else None))
        expected = whole.frame(index, found)
        row = json.loads(json.dumps(tracker.snapshot(cut)))  # as a store would give it back
        cut, before = tracker.restored(row | {"origins": {int(k): v for k, v in row["origins"].items()}}, track, cfg), cut
        told += before.samples
        assert cut.frame(index, found) == expected
    assert whole.exits == cut.exits > 0 and cut.origins == whole.origins and told + cut.samples == whole.samples


def test_parts_give_what_whole_sessions_give(spark):
    boxes, zones = fixtures.walkers(spark, "/root/testdata/sf0.001"), fixtures.frame_zones(spark, "/root/testdata/sf0.001")
    boxes = boxes.union(boxes.where("session_id = 's1'").withColumn("session_id", F.lit("unzoned")).withColumn("frame_index", F.col("frame_index") + 400))
    late = boxes.where("session_id = 's2' and frame_index > 200").withColumn("frame_index", F.col("frame_index") + 900)  # an empty part between
    boxes = boxes.union(late)
    rows = lambda df: sorted(map(str, df.collect()))
    whole = rows(tracker.folded(boxes, zones, TrackConfig(), CountConfig()))
    kept = {}
    parts = tracker.folded(boxes, zones, TrackConfig(), CountConfig(), 130, kept.__setitem__)
    assert len(kept) > 5 and rows(parts) == whole
    assert any(r.kind == "SNAPSHOT" and r.found for r in kept[1].collect())
    # A run that was stopped behind its third part goes on from there
    rest = tracker.folded(boxes, zones, TrackConfig(), CountConfig(), 130, since=(2, kept[2]))
    first = [r for k in range(3) for r in rows(kept[k].where("kind <> 'SNAPSHOT'").select(*tracker.TOLD))]
    assert sorted(first + rows(rest)) == whole


def test_a_stream_restarts_from_its_typed_state(spark, tmp_path):
    """Frames come in three runs of one query; each takes up the tracks, locks and counters that the run before has stored, and idle or ended sessions are forgotten."""
    from trackweave.streaming import sessions

    zones = spark.createDataFrame([("a", [(0.0, 0.55), (1.0, 0.55), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 0.45), (0.0, 0.45)], [(0.2, 0.3), (0.8, 0.3), (0.8, 0.65), (0.2, 0.65)], [(0.0, 0.9), (1.0, 0.9), (1.0, 1.0), (0.0, 1.0)], 640, 480)],
                                  "session_id string, salon array<struct<x: double, y: double>>, street array<struct<x: double, y: double>>, door array<struct<x: double, y: double>>, spawn array<struct<x: double, y: double>>, frame_width int, frame_height int")
    box = "x1: double, y1: double, x2: double, y2: double"
    schema = f"session_id string, frame_index int, ended boolean, detections array<struct<{box}, confidence: double, body: struct<{box}>>>"
    cfg = CountConfig(stride=1, stable_samples=2, lost_frames=2, startup_frames=1)
    path = [440.0 - 20 * k for k in range(21)] + [None] * 6
    lines = [{"session_id": "a", "frame_index": k, "ended": k == len(path) - 1, "detections": [] if y is None else [{"x1": 300.0, "y1": y - 20, "x2": 340.0, "y2": y + 20, "confidence": 0.9, "body": {"x1": 280.0, "y1": y - 20, "x2": 360.0, "y2": y + 140}}]} for k, y in enumerate(path)]
    c = SessionCore(tracker.zones_of({k: [{"x": p[0], "y": p[1]} for p in zones.first()[k]] for k in ("salon", "street", "door", "spawn")} | {"frame_width": 640, "frame_height": 480}), 480.0, TrackConfig(), cfg)
    expected = [e for r in lines for e in c.frame(r["frame_index"], [tracker.seen_of(d) for d in r["detections"]])]
    assert len(expected) == 1
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in lines[k * 9 : k * 9 + 9]))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        run = sessions.live_exits(stream, zones, TrackConfig(), cfg, idle_ms=None).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            assert run.awaitTermination(120)
        finally:
            run.stop()
    found = spark.read.schema(sessions.OUT).parquet(str(tmp_path / "out")).collect()
    assert [(r.frame_index, r.track_id, r.total_exits) for r in found] == [(e["frame_index"], e["track_id"], e["total_exits"]) for e in expected]


def frames(states, active=(), street=None):
    return [("s", k * 10, 10.0, [0.1, 0.3, 0.5, 0.7] if s else [0.9, 0.7, 0.5, 0.3], (street or {}).get(k, [0.2, 0.2, 0.2, 0.2]), k in active) for k, s in enumerate(states)]


DOOR = "session_id string, frame_index int, fps double, door array<double>, street array<double>, active boolean"
CFG = StopConfig(calibration_samples=2, open_max=0.05, closed_min=0.10, closed_confirm_s=2, clear_s=1, post_roll_s=1, min_seconds=0)


@pytest.mark.parametrize(("states", "active", "stops"), [([1] * 5 + [0] * 8, (0,), True), ([1] * 5 + [0] * 3 + [1] * 5, (0,), False), ([1] * 13, (0,), False), ([1] * 5 + [0] * 8, (), False)])
def test_smart_stop(spark, states, active, stops):
    found = smart_stop.stop_points(spark.createDataFrame(frames(states, active), DOOR), CFG).toPandas()
    assert bool(found["stopped"].any()) == stops
    if stops:
        assert found[found["stopped"]]["reason"].iloc[0] == "DOOR_CLOSED" and found.sort_values("frame_index")["phase"].iloc[-1] == "FINISHED"


def test_maximum_duration_can_not_be_cancelled(spark):
    cfg = StopConfig(**{**CFG.__dict__, "max_seconds": 3.0})
    found = smart_stop.stop_points(spark.createDataFrame(frames([1] * 8, (0, 4)), DOOR), cfg).toPandas().sort_values("frame_index")
    assert found["reason"].iloc[-1] == "MAX_DURATION" and found["stopped"].tolist() == [False] * 4 + [True] * 4


def test_no_detections_give_no_rows(spark):
    none = spark.createDataFrame([], schemas.DETECTIONS)
    zones = spark.createDataFrame([], schemas.ZONES)
    assert tracker.live_exits(none, zones, TrackConfig(), CountConfig()).count() == 0


def test_walkers_are_all_tracks(spark):
    of = lambda rows, c: {tuple(r) for r in rows.select("session_id", c).distinct().collect()}
    assert of(fixtures.walkers(spark, "/root/testdata/sf0.001"), "det_seq") == of(fixtures.samples(spark, "/root/testdata/sf0.001"), "track_id")


def by_session(detections, zones, count):
    """An independent model: every session's frames one by one through the core."""
    out = {}
    for r in zones.collect():
        core = SessionCore(tracker.zones_of(r.asDict(recursive=True)), r.frame_height, TrackConfig(), count)
        mine = [d.asDict(recursive=True) for d in detections.where(f"session_id = '{r.session_id}'").orderBy("frame_index", "det_seq").collect()]
        for index in range(mine[0]["frame_index"], mine[-1]["frame_index"] + count.stride * (count.lost_frames + 2) + 1, count.stride):
            core.frame(index, [tracker.seen_of(d) for d in mine if d["frame_index"] == index])
        out[r.session_id] = core
    return out


def test_one_pass_gives_samples_origins_and_exits(spark):
    from trackweave.config import FateConfig
    from trackweave.plans import two_pass

    folder, count = "/root/testdata/sf0.001", CountConfig()
    walkers, zones = fixtures.walkers(spark, folder), fixtures.frame_zones(spark, folder)
    right = by_session(walkers, zones, count)
    rows = tracker.folded(walkers, zones, TrackConfig(), count)
    found = tracker.samples_of(rows).collect()
    for session, core in right.items():
        assert sorted((r.track_id, r.seq, r.frame_index, r.zone, r.again) for r in found if r.session_id == session) == sorted((x["track_id"], x["seq"], x["frame_index"], x["zone"], x["again"]) for x in core.samples)
    assert {(r.session_id, r.track_id, r.origin) for r in tracker.origins_of(rows).collect()} == {(s, t, o) for s, core in right.items() for t, o in core.origins.items()}
    results = {r.session_id: r for r in two_pass.analyse(walkers, zones, TrackConfig(), count, FateConfig()).collect()}
    for session, core in right.items():
        inside: dict[int, int] = {}
        for x in core.samples:
            if not x["again"]:
                inside[x["frame_index"]] = inside.get(x["frame_index"], 0) + (x["zone"] == "INSIDE")
        r = results[session]
        assert r.live_exits == core.exits and r.exits == max(r.live_exits, r.offline_exits)
        assert r.initial == max([v for _, v in sorted(inside.items())][:25]) and r.onboard == min(max(r.initial - r.exits, 0), 120)


def test_a_person_who_stands_in_the_salon_counts_once(spark):
    from trackweave.config import FateConfig
    from trackweave.plans import two_pass

    still = [("s", k * 3, 0, 300.0, 400.0, 330.0, 440.0, 0.9, None, None) for k in range(20)]
    zones = fixtures.frame_zones(spark, "/root/testdata/sf0.001").limit(1).withColumn("session_id", F.lit("s"))
    (r,) = two_pass.analyse(spark.createDataFrame(still, schemas.DETECTIONS), zones, TrackConfig(), CountConfig(), FateConfig()).collect()
    assert (r.initial, r.exits, r.onboard) == (1, 0, 1)


def crossings(ys, line, half, cfg):
    """The line's machine in plain Python."""
    state, zone, run, boarded, alighted, b, a = "UNKNOWN", None, 0, False, False, 0, 0
    for k, y in enumerate(ys):
        above = y < line - half
        now = ("INSIDE" if above == cfg.inside_on_top else "OUTSIDE") if above or y > line + half else "DOORWAY"
        run, zone = (run + 1 if now == zone else 1), now
        inward = (ys[0] - y) if cfg.inside_on_top else (y - ys[0])
        crossed = k > 0 and ((ys[k - 1] >= line > y) if cfg.inside_on_top else (ys[k - 1] <= line < y))
        board = leave = False
        if cfg.center_crossing and not boarded and crossed and inward >= cfg.min_move_px:
            board = True
        elif run < cfg.stable_samples:
            continue
        elif alighted and zone == "INSIDE":
            alighted, state, a = False, "INSIDE", a - 1
        elif boarded and zone == "OUTSIDE":
            boarded, state, b = False, "OUTSIDE", b - 1
        elif zone == "DOORWAY":
            state = {"OUTSIDE": "FROM_OUTSIDE", "ALIGHTED": "FROM_OUTSIDE", "INSIDE": "FROM_INSIDE", "BOARDED": "FROM_INSIDE"}.get(state, state)
        elif zone == "INSIDE":
            board = state in ("OUTSIDE", "FROM_OUTSIDE") or (state == "UNKNOWN" and inward >= cfg.min_move_px)
            state = state if board or state in ("BOARDED", "ALIGHTED") else "INSIDE"
        else:
            leave = state in ("INSIDE", "FROM_INSIDE") and -inward >= cfg.min_move_px
            state = "OUTSIDE" if not leave and state in ("UNKNOWN", "FROM_OUTSIDE", "FROM_INSIDE") else state
        if board and not boarded:
            boarded, alighted, state, b = True, False, "BOARDED", b + 1
        if leave and not alighted:
            alighted, boarded, state, a = True, False, "ALIGHTED", a + 1
    return b, a


@pytest.mark.parametrize("cfg", [LineConfig(), LineConfig(inside_on_top=False), LineConfig(center_crossing=True, stable_samples=2), LineConfig(min_move_px=5.0, stable_samples=1)])
def test_line_mode_matches_plain_python(spark, cfg):
    rng = random.Random(4)
    walks = []
    for _ in range(120):
        y, walk = rng.uniform(0, 200), []
        for _ in range(rng.randint(1, 40)):
            y = min(200.0, max(0.0, y + rng.choice([-25, -10, 0, 10, 25]) * rng.choice([1, 1, 3])))
            walk.append(y)
        walks.append(walk)
    rows = [("s", t, k, y) for t, walk in enumerate(walks) for k, y in enumerate(walk)]
    found = line_counter.line_tracks(spark.createDataFrame(rows, "session_id string, track_id int, frame_index int, anchor_y double"), 100.0, 20.0, cfg).collect()
    assert {r.track_id: (r.boardings, r.alightings) for r in found} == {t: crossings(walk, 100.0, 20.0, cfg) for t, walk in enumerate(walks)}


def test_events_wait_for_the_next_message(spark):
    from trackweave.operators import messages

    frames = spark.createDataFrame([("s", k, k * 50, k == 8, k) for k in range(10)], "session_id string, frame_index int, at_ms long, stopped boolean, exited int")
    events = spark.createDataFrame([("s", 1, 7), ("s", 2, 8), ("s", 4, 9), ("s", 9, 5)], "session_id string, frame_index int, track_id int")
    boxes = spark.createDataFrame([("s", 3, 1, 0.5)], "session_id string, frame_index int, track_id int, x1 double")
    found = {r.frame_index: r for r in messages.frame_messages(frames, boxes, events).collect()}
    assert {k: r.n_events for k, r in found.items()} == {0: 0, 3: 2, 6: 1, 8: 0}
    assert json.loads(found[3].payload) == {"frame_index": 3, "detections": [{"track_id": 1, "x1": 0.5}], "events": [{"frame_index": 1, "track_id": 7}, {"frame_index": 2, "track_id": 8}], "exited": 3}


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_overlapping_pairs_are_chosen_as_by_going_through_all_of_them(monkeypatch, rounds):
    monkeypatch.setattr(tracker, "ROUNDS", rounds)
    rng = random.Random(rounds)
    for size in (1, 6, 60):
        box = lambda: (lambda x, y: (x, y, x + rng.choice((20.0, 40.0)), y + 40.0))(rng.randrange(0, 60, 5) * 1.0, rng.randrange(0, 60, 5) * 1.0)
        tracks, found = [box() for _ in range(size)], [box() for _ in range(size)]
        kinds = {}
        kind = [kinds.setdefault(b, len(kinds)) for b in found]
        pairs = sorted((-tracker.overlap(f, t), tracker.centers(f, t), i, j) for i, t in enumerate(tracks) for j, f in enumerate(found) if tracker.overlap(f, t) >= 0.3)
        wanted, used = {}, set()
        for *_, i, j in pairs:
            if i not in wanted and kind[j] not in used:
                wanted[i] = j
                used.add(kind[j])
        got = tracker.overlapping(np.array(tracks).T, np.array(found).T, np.array(kind), 0.3)
        assert dict(zip(*got, strict=True)) == wanted


def test_a_crowd_is_matched_without_holding_its_pairs():
    """1,500 tracks and as many boxes that nearly all overlap are two million pairs; memory follows the boxes."""
    import tracemalloc

    rng = random.Random(3)
    box = lambda: (lambda x, y: (x, y, x + 200.0, y + 200.0))(rng.uniform(0, 40), rng.uniform(0, 40))
    tracks, found = [box() for _ in range(1500)], [box() for _ in range(1500)]
    tracemalloc.start()
    i, j = tracker.overlapping(np.array(tracks).T, np.array(found).T, np.arange(1500), 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(i)) == len(set(j)) == 1500 and peak < 40 << 20


def test_lost_tracks_that_can_not_come_back_are_not_kept():
    c = core(track=TrackConfig(archive_after=2, fallback_lost=1))
    for k in range(40):
        c.frame(k, [head(200 + k % 2 * 200, x=40.0 * (k % 16))])
    assert c.next_id > len(c.active) + 1 and not c.lost
    # Those whose place still counts are kept
    late = core(track=TrackConfig(archive_after=2))
    walk(late, [400, 400, None, None, None, None])
    assert [t.ident for t in late.lost] == [1]
    late.frame(6, [head(270)])
    assert late.next_id == 2 and not late.lost


def test_crowds_of_equal_boxes_are_matched_and_return_one_by_one():
    """Against going through all pairs: many tracks at few places, in all orders of frames."""
    rng = random.Random(8)
    c, places = core(), [head(y, x=x) for y in (150, 230, 300) for x in (250.0, 330.0, 420.0)]
    for k in range(25):
        found = [rng.choice(places) for _ in range(rng.randrange(30))]
        tracks = [t for t in c.active if not t.alighted]
        kinds = list(dict.fromkeys(found))
        wanted: dict[int, Seen] = {}
        for key, least in ((lambda s, px: (-s, px), 0.3), (lambda s, px: (px, -s), None)):
            pairs = []
            for i, t in enumerate(tracks):
                for j, d in enumerate(kinds):
                    s, px = tracker.overlap(d.whole, t.seen.whole), tracker.centers(d.whole, t.seen.whole)
                    side = max(d.whole[2] - d.whole[0], d.whole[3] - d.whole[1], t.seen.whole[2] - t.seen.whole[0], t.seen.whole[3] - t.seen.whole[1])
                    if (s >= least) if least else px <= min(c.t.center_px, side * c.t.center_size_factor):
                        pairs.append((*key(s, px), i, j))
            for *_, i, j in sorted(pairs):
                if tracks[i].ident not in wanted and kinds[j] not in wanted.values():
                    wanted[tracks[i].ident] = kinds[j]
        assert c._match(found) == wanted
        c.frame(k, found)
    assert c.next_id > 60
