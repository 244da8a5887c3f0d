"""Folds as scans over stretches: against plain folds over whole sequences, for all ways of cutting."""

import random
from itertools import product

import pytest

from trackweave.config import LineConfig, StopConfig
from trackweave.operators import line_counter, messages, scan, smart_stop

CUTS = [(4096, 4096), (16, 3), (7, 2)]


def sent_by_fold(frames, every):
    out, last = {}, {}
    for s, i, at, stopped in sorted(frames, key=lambda f: f[:2]):
        due = last.get(s) is None or at is None or at - last[s] >= every or stopped
        if due:
            last[s] = at
        out[s, i] = due
    return out


def clocks():
    rng = random.Random(11)
    for s, kind in enumerate(("even", "slow", "fast", "back", "gaps", "stops", "unknown", "mixed", "same")):
        at, i = 1000 * s, rng.randrange(50)
        for _ in range(rng.choice([1, 60, 300])):
            at += {"even": 40, "slow": 400, "fast": 1, "back": rng.choice([-300, 20, 70, 90]), "gaps": rng.choice([1, 30, 5000]), "same": 0}.get(kind, rng.choice([-50, 10, 40, 80, 130]))
            i += rng.choice([1, 1, 2, 9])
            yield f"s{s}", i, None if kind in ("unknown", "mixed") and rng.random() < 0.1 else at, kind in ("stops", "mixed") and rng.random() < 0.1


@pytest.mark.parametrize("size,fan", CUTS)
def test_throttle(spark, size, fan):
    rows = list(clocks())
    frames = spark.createDataFrame(rows, "session_id string, frame_index int, at_ms long, stopped boolean").repartition(3)
    found = {(r.session_id, r.frame_index): r.sent for r in messages.emitted(frames, 120, size, fan).collect()}
    assert found == sent_by_fold(rows, 120)


def test_throttle_of_no_frames(spark):
    frames = spark.createDataFrame([], "session_id string, frame_index int, at_ms long, stopped boolean")
    assert messages.emitted(frames).count() == 0


def line_by_fold(ys, line, half, cfg):
    """The counting mode told sample by sample."""
    side, boarded, alighted, held, run, before, boardings, exits = "UNKNOWN", False, False, None, 0, None, 0, 0
    top = cfg.inside_on_top
    for y in ys:
        zone = "DOORWAY" if abs(y - line) <= half else "INSIDE" if (y < line) == top else "OUTSIDE"
        run, held = (run + 1 if zone == held else 1), zone
        inward = (ys[0] - y) if top else (y - ys[0])
        crossed = cfg.center_crossing and before is not None and ((before >= line > y) if top else (before <= line < y))
        before = y
        board = exit_ = False
        if crossed and not boarded and inward >= cfg.min_move_px:
            board = True
        elif run < cfg.stable_samples:
            continue
        elif alighted and zone == "INSIDE":
            side, alighted, exits = "INSIDE", False, exits - 1
            continue
        elif boarded and zone == "OUTSIDE":
            side, boarded, boardings = "OUTSIDE", False, boardings - 1
            continue
        elif side in ("UNKNOWN", "OUTSIDE", "FROM_OUTSIDE") and zone == "INSIDE":
            board = side != "UNKNOWN" or inward >= cfg.min_move_px
            side = side if board else "INSIDE"
        elif side in ("INSIDE", "FROM_INSIDE") and zone == "OUTSIDE":
            exit_ = -inward >= cfg.min_move_px
            side = side if exit_ or side == "INSIDE" else "OUTSIDE"
        elif zone == "DOORWAY":
            side = {"OUTSIDE": "FROM_OUTSIDE", "INSIDE": "FROM_INSIDE", "BOARDED": "FROM_INSIDE", "ALIGHTED": "FROM_OUTSIDE"}.get(side, side)
        elif side in ("UNKNOWN", "FROM_OUTSIDE") and zone == "OUTSIDE":
            side = "OUTSIDE"
        elif side == "FROM_INSIDE" and zone == "INSIDE":
            side = "INSIDE"
        if board and not boarded:
            side, boarded, alighted, boardings = "BOARDED", True, False, boardings + 1
        if exit_ and not alighted:
            side, boarded, alighted, exits = "ALIGHTED", False, True, exits + 1
    return boardings, exits, side


@pytest.mark.parametrize("top,crossing", list(product((False, True), repeat=2)))
def test_line_machine(spark, top, crossing):
    rng = random.Random(5)
    cfg = LineConfig(inside_on_top=top, center_crossing=crossing, stable_samples=2, min_move_px=30.0)
    rows, want = [], {}
    for t in range(40):
        y, ys = rng.choice([40.0, 100.0, 160.0]), []
        for _ in range(rng.choice([1, 30, 90])):
            y = min(max(y + rng.choice([-25, -5, 0, 5, 25]) * rng.choice([1, 1, 2]), 0.0), 200.0)
            ys.append(y)
        want[t] = line_by_fold(ys, 100.0, 20.0, cfg)
        rows += [(f"s{t % 3}", t, k // 2, k, y) for k, y in enumerate(ys)]  # two samples a frame: seq decides
    samples = spark.createDataFrame(rows, "session_id string, track_id int, frame_index int, seq int, anchor_y double").repartition(4)
    for size, fan in CUTS:
        found = {r.track_id: (r.boardings, r.alightings, r.state) for r in line_counter.line_tracks(samples, 100.0, 20.0, cfg, size, fan).collect()}
        assert found == want
    assert any(b for b, *_ in want.values()) and any(e for _, e, _ in want.values())


def stops_by_fold(rows, cfg):
    out = {}
    for s in sorted({r["session_id"] for r in rows}):
        candidate = smart_stop.Candidate(cfg)
        for r in sorted((r for r in rows if r["session_id"] == s), key=lambda r: r["frame_index"]):
            candidate.step(r)
            out[s, r["frame_index"]] = (candidate.reason, candidate.stopped)
    return out


@pytest.mark.parametrize("post", [0.0, 4.0, 25.0])
def test_stop_machine(spark, post):
    rng = random.Random(int(post))
    cfg = StopConfig(post_roll_s=post, min_seconds=5.0, max_seconds=200.0, closed_confirm_s=2.0, clear_s=3.0, inactivity_s=6.0, motion_fallback=True)
    rows = []
    for s in range(6):
        closed_s, idle, seen = 0.0, 0.0, False
        for k in range(rng.choice([3, 200, 260])):
            active = rng.random() < (0.03 if s % 2 else 0.15)
            seen |= active
            idle = 0.0 if active else idle + 1.0
            door = "CLOSED" if (k // 17 + s) % 2 and rng.random() < 0.93 else rng.choice(["OPEN", "UNKNOWN"])
            closed_s = closed_s + 1.0 if door == "CLOSED" else 0.0
            rows.append({"session_id": f"s{s}", "frame_index": k * 3, "video_s": float(k), "active": active, "door_state": door, "closed_s": closed_s, "idle_s": idle if seen else 0.0, "activity_seen": seen, "vehicle_moving": (k // 9) % 3 == 1})
    facts = spark.createDataFrame(rows, "session_id string, frame_index int, video_s double, active boolean, door_state string, closed_s double, idle_s double, activity_seen boolean, vehicle_moving boolean")
    want = stops_by_fold(rows, cfg)
    for size, fan in CUTS:
        found = scan.scanned(scan.with_stretch(facts, "frame_index", size), ["session_id"], ["frame_index"], smart_stop.StopMachine(cfg), fan).collect()
        assert {(r.session_id, r.frame_index): (r.reason, r.stopped) for r in found} == want
    assert any(x[1] for x in want.values())


def test_standing_vehicles_move_without_a_time_to_confirm(spark):
    frames = spark.createDataFrame([("s", k, 10.0, [0.1, 0.9], [0.2, 0.8], False) for k in range(3)], "session_id string, frame_index int, fps double, door array<double>, street array<double>, active boolean")
    assert all(r.vehicle_moving for r in smart_stop.door_states(frames, StopConfig(vehicle_confirm_s=0.0)).collect())
    assert not any(r.vehicle_moving for r in smart_stop.door_states(frames, StopConfig(vehicle_confirm_s=1.0)).collect())


def test_frames_of_a_clip_are_never_broadcast(spark):
    """Exploded frames are estimated as small as what they came from; they go through the scan and are joined to nothing but tables of stretches."""
    frames = spark.range(20).selectExpr("'s' as session_id", "explode(sequence(id * 10, id * 10 + 9)) as frame_index", "named_struct('n', id) as more").selectExpr("*", "frame_index * 50 as at_ms", "frame_index = 199 as stopped")
    sent = messages.emitted(frames, 120, stretch=16, fan=4)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("Join") == 2 and "Inner" not in plan
    rows = sorted(sent.collect(), key=lambda r: r.frame_index)
    assert sent.columns == ["session_id", "frame_index", "more", "at_ms", "stopped", "sent"] and [r.more.n for r in rows] == [k // 10 for k in range(200)]
    assert [r.frame_index for r in rows if r.sent] == [*range(0, 199, 3), 199]


def test_door_states_don_t_depend_on_how_sessions_are_cut(spark):
    rng = random.Random(5)
    rows = []
    for session, fps in (("a", 10.0), ("b", 8.0), (None, 4.0)):
        for k in range(0, 160, 2):
            door = [0.1 * (k // 40 % 2) + 0.3 * i * (1 - 2 * (k // 40 % 2)) for i in range(4)] if rng.random() > 0.05 else None
            rows.append((session, k + rng.randrange(2), fps, door, [rng.choice((0.0, 1.0)) for _ in range(4)], rng.random() < 0.05))
    frames = spark.createDataFrame(rows, "session_id string, frame_index int, fps double, door array<double>, street array<double>, active boolean")
    cfg = StopConfig(need_activity=True, calibration_samples=3, vehicle_confirm_s=0.5)
    exact = lambda r: repr([round(x, 9) if isinstance(x, float) else x for x in r])  # noqa: E731  # sums of seconds may differ in the last bit
    told = [sorted(map(exact, smart_stop.door_states(frames, cfg, size).collect())) for size in (8, 1 << 20)]
    assert set(told[0]) ^ set(told[1]) == set() and len(told[0]) == len(rows)
    seconds = lambda name: max(r[name] for r in smart_stop.door_states(frames, cfg, 8).collect())
    assert seconds("moving_s") > 1.0 and seconds("idle_s") > 2.0  # longer than a stretch


def test_frames_of_messages_are_read_once_and_packed_by_stretch(spark):
    """Two sessions whose frames come in any order, with a frame without a time and one that stops; the frames go through one shuffle, later passes move a value a stretch."""
    from trackweave.operators import messages

    rng, rows = random.Random(2), []
    for session in ("a", "b"):
        rows += [(session, k, None if k == 41 else k * 50 + rng.randrange(30), k == 97, k % 3) for k in range(-20, 300) if k % 37]
    rows += [(None, 5, 7, False, 1), ("a", None, 9, False, 1)]
    rng.shuffle(rows)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    schema = "session_id string, frame_index int, at_ms long, stopped boolean, visible int"
    frames = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    found = {(r.session_id, r.frame_index): (r.at_ms, r.stopped, r.visible, r.sent) for r in messages.emitted(frames, 120, stretch=16, fan=3).collect()}
    wanted = {}
    for session in ("a", "b"):
        last, known = None, False
        for _, k, at, stopped, visible in sorted((r for r in rows if r[0] == session and r[1] is not None), key=lambda r: r[1]):
            sent = at is None or not known or stopped or at - last >= 120
            wanted[session, k] = (at, stopped, visible, sent)
            if sent:
                last, known = at, at is not None
    assert found == wanted and read.value == len(rows)
