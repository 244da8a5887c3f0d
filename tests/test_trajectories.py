"""Visits and fates on hand-made series, with the thresholds that the cases are made for."""

import pytest
from pyspark.sql import functions as F

from trackweave import schemas
from trackweave.config import FateConfig, LineConfig
from trackweave.operators import line_counter, trajectories

CFG = FateConfig(stable_samples=3, shrink_ratio=0.92, min_move_px=40, lost_frames=3, min_body_ratio=0.18, successor_gap=15, successor_px=120)
I, O, B = "INSIDE", "OUTSIDE", "BUFFER"


def series(track, zones, ys, heads, door=(), x=400.0, start=0, body=1.0, spawn=False):
    return [("s", track, k, start + k, z, k in door, x, float(y), float(h), body, spawn) for k, (z, y, h) in enumerate(zip(zones, ys, heads, strict=True))]


def fates(spark, rows, origins=(), final=None, cfg=CFG):
    samples = spark.createDataFrame(rows, schemas.SAMPLES)
    known = spark.createDataFrame([("s", t, o) for t, o in origins], schemas.ORIGINS) if origins else None
    ends = spark.createDataFrame([("s", final)], "session_id string, final_frame_index int") if final is not None else None
    return {r.track_id: (r.exits, r.fate) for r in trajectories.track_fates(samples, cfg, known, ends).collect()}


OUT = series(1, [I] * 3 + [B] + [O] * 3, [320, 318, 316, 240, 180, 170, 160], [52, 52, 52, 48, 44, 42, 40], door=(3,))


@pytest.mark.parametrize(
    ("rows", "origins", "final", "expected"),
    [
        (OUT, (), None, (1, "EXITED")),
        (OUT[:2], (), None, (0, "UNDECIDED")),
        (series(1, [I] * 6, [320] * 6, [52] * 6), (), None, (0, "ONBOARD_STATIONARY")),
        (series(1, [O] * 6, [160] * 6, [40] * 6), (), None, (0, "PASSERBY")),
        (series(1, [O] * 3 + [I] * 3, [160] * 3 + [320] * 3, [40] * 3 + [52] * 3, door=(2,)), (), None, (0, "UNDECIDED")),
        # Far pedestrians don't count, but those in the exit when the clip began do.
        (series(1, [I] * 3 + [O] * 3, [320] * 3 + [160] * 3, [52] * 3 + [40] * 3, door=(3,), body=0.1), (), None, (0, "PASSERBY")),
        (series(1, [O] * 4, [160] * 4, [40] * 4), ((1, "STARTUP_OUTSIDE"),), 100, (1, "EXITED")),
        (series(1, [O] * 4, [160] * 4, [40] * 4), ((1, "STARTUP_OUTSIDE"),), 5, (0, "PASSERBY")),
        (series(1, [B] * 4, [240] * 4, [40] * 4, door=(0, 1)), ((1, "STARTUP_DOOR"),), 100, (1, "EXITED")),
        (series(1, [B] * 4, [240] * 4, [40] * 4), (), 100, (0, "UNDECIDED")),
        # No door, no shrinking: the move alone isn't enough.
        (series(1, [I] * 3 + [O] * 3, [320] * 3 + [160] * 3, [50] * 6), (), None, (0, "UNDECIDED")),
        (series(1, [I] * 3 + [O] * 3, [320] * 3 + [300] * 3, [50] * 6, door=(2,)), (), None, (0, "UNDECIDED")),
        # Two ways out.
        (series(1, ([I] * 3 + [O] * 3) * 2, ([320] * 3 + [160] * 3) * 2, [50] * 12, door=(2,)), (), None, (2, "EXITED")),
        # Lost at the exit, moving over the last two samples; then with a jump in the last one only.
        (series(1, [I] * 4 + [B, B], [320] * 4 + [270, 230], [52] * 4 + [46, 42], door=(4, 5)), (), None, (1, "EXITED")),
        (series(1, [I] * 4 + [B, B], [320] * 4 + [318, 230], [52] * 4 + [52, 42], door=(5,)), (), None, (0, "ONBOARD_STATIONARY")),
    ],
)
def test_fates(spark, rows, origins, final, expected):
    assert fates(spark, rows, origins, final)[1] == expected


def test_a_stationary_newborn_suppresses_a_loss(spark):
    lost = series(1, [I] * 4 + [B, B], [320] * 4 + [270, 230], [52] * 4 + [46, 42], door=(4, 5))
    newborn = series(2, [B] * 4, [235] * 4, [42] * 4, start=8)
    assert fates(spark, lost + newborn)[1] == (0, "ONBOARD_STATIONARY")
    assert fates(spark, lost + series(2, [B] * 4, [235] * 4, [42] * 4, start=30))[1] == (1, "EXITED")


def test_a_fragment_and_its_successor_both_count_unless_an_origin_is_required(spark):
    a = series(1, [I] * 4 + [B, O], [319] * 4 + [260, 220], [52] * 4 + [46, 40], door=(4,))
    b = series(2, [I] * 3 + [O] * 3, [320] * 3 + [160] * 3, [50] * 6, door=(2,))
    found = fates(spark, a + b, ((2, "STARTUP_INSIDE"),))
    assert [found[1][0], found[2][0]] == [1, 1]
    strict = FateConfig(**{**CFG.__dict__, "require_exit_origin": True})
    assert fates(spark, a + b, ((2, "STARTUP_INSIDE"),), cfg=strict)[1][0] == 0


def test_samples_are_a_bag(spark):
    """Two startup frames that are recorded twice make a stable visit."""
    rows = [("s", 1, k, k // 2, I, False, 400.0, 320.0, 50.0, 1.0, False) for k in range(4)]
    assert trajectories.stable_visits(spark.createDataFrame(rows, schemas.SAMPLES), 3).first().samples == 4


def test_median_and_head_average(spark):
    rows = [("s", 1, k, k, I, False, 0.0, 0.0, float(h), 1.0, False) for k, h in enumerate([1, 2, 4, 10])]
    samples = spark.createDataFrame(rows, schemas.SAMPLES)
    assert trajectories.stable_visits(samples, 3).first().median_head == 3.0
    assert [r.smooth_head for r in trajectories.head_average(samples, 2).orderBy("seq").collect()] == [1.0, 1.5, 3.0, 7.0]


def test_line_mode_cancels_a_return(spark):
    rows = series(1, [B] * 9, [100] * 3 + [300] * 3 + [100] * 3, [50] * 9) + series(2, [B] * 6, [100] * 3 + [300] * 3, [50] * 6)
    found = line_counter.line_counts(spark.createDataFrame(rows, schemas.SAMPLES), 200.0, 10.0, LineConfig(inside_on_top=False)).first()
    assert (found.boardings, found.alightings) == (1, 0)


def test_final_exits_are_the_greater_count(spark):
    counted = spark.createDataFrame([("a", 1, 2, "EXITED"), ("b", 1, 0, "PASSERBY")], "session_id string, track_id int, exits long, fate string")
    live = spark.createDataFrame([("a", 1), ("c", 4)], "session_id string, live_exits long")
    found = trajectories.session_totals(counted, live)
    assert {r.session_id: r.exits for r in found.orderBy(F.col("session_id")).collect()} == {"a": 2, "b": 0, "c": 4}


def test_near_pairs_are_all_found_and_stay_few(spark):
    import random

    from trackweave.operators import near

    def points(n, seed):
        rng = random.Random(seed)
        return [("s", k, rng.uniform(-300, 3000), rng.uniform(-300, 3000), rng.randrange(15 * n)) for k in range(n)]

    kind = "session_id string, track_id int, x double, y double, t int"
    close = lambda a, b: 0 <= b[4] - a[4] <= 50 and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 120**2
    share = []
    for n in (200, 800):
        ends, begins = points(n, 1), points(n, 2)
        begins += [("s", n + k, ends[0][2] + k % 7, ends[0][3], ends[0][4] + 1) for k in range(60)]  # a hot cell
        right = {(a[1], b[1]) for a in ends for b in begins if close(a, b)}
        for hot in (4096, 10):
            pairs = near.soon_and_near(spark.createDataFrame(ends, kind), spark.createDataFrame(begins, kind), ["session_id"], 120.0, 50.0, hot).collect()
            met = [(r.track_id, r.track_id_b) for r in pairs]
            assert len(set(met)) == len(met) and right <= set(met)
        share.append((len(met) - 60) / n)
    assert share[1] < 2 * share[0] + 0.2  # four times as many tracks in four times the time: about as many pairs for each end


def test_a_successor_is_searched_without_a_row_for_each_pair(spark):
    n = 300
    facts = spark.createDataFrame(
        [("s", k, {"x": 0.0, "y": 0.0, "frame_index": 0 if k < n else 3}, {"x": 0.0, "y": 0.0, "frame_index": 0 if k < n else 3}, 0.0) for k in range(2 * n)],
        "session_id string, track_id int, first struct<x: double, y: double, frame_index: int>, last struct<x: double, y: double, frame_index: int>, early_shift double",
    )
    found = trajectories.with_stationary_successor(None, FateConfig(), facts)
    assert {r.track_id for r in found.collect()} == set(range(n))
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()
