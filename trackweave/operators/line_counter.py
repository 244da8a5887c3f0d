"""Optional counting mode ``line``: a band around a horizontal line, counted in both directions.

One side of the band is inside, the other outside, the band itself the doorway. A zone is stable after some samples in a row.
Each track is a state machine over its samples: stable sides and passages through the doorway count a boarding or an exit, and
a stable return cancels it. Exits, and boardings that begin in the doorway, need a movement of some pixels from the first sample.

The machine has few states: a side, two flags, and how long the zone has held, up to what is stable. So it runs as a scan: a stretch of a track becomes a
map from the state before it to the state behind it with what was counted, and however long a track is, no task holds more than a stretch of it.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LineConfig
from . import scan
from .trajectories import TRACK

SIDES = ("INSIDE", "OUTSIDE", "DOORWAY")
#: What a stable zone does to a state: (state, zone) to what happens, for movements that are far enough. BOARD and EXIT are counted; others name the next state.
STABLE = {
    ("UNKNOWN", "OUTSIDE"): "OUTSIDE", ("UNKNOWN", "INSIDE"): "BOARD",
    ("OUTSIDE", "DOORWAY"): "FROM_OUTSIDE", ("OUTSIDE", "INSIDE"): "BOARD",
    ("INSIDE", "DOORWAY"): "FROM_INSIDE", ("INSIDE", "OUTSIDE"): "EXIT",
    ("FROM_OUTSIDE", "INSIDE"): "BOARD", ("FROM_OUTSIDE", "OUTSIDE"): "OUTSIDE",
    ("FROM_INSIDE", "OUTSIDE"): "EXIT", ("FROM_INSIDE", "INSIDE"): "INSIDE",
    ("BOARDED", "DOORWAY"): "FROM_INSIDE", ("ALIGHTED", "DOORWAY"): "FROM_OUTSIDE",
}
#: What happens instead where the movement is too short.
SHORT = {("UNKNOWN", "INSIDE"): "INSIDE", ("INSIDE", "OUTSIDE"): None, ("FROM_INSIDE", "OUTSIDE"): "OUTSIDE"}


def band_zone(y: Column, line_y: float, half: float, inside_on_top: bool) -> Column:
    above, under = ("INSIDE", "OUTSIDE") if inside_on_top else ("OUTSIDE", "INSIDE")
    return F.when(y < line_y - half, above).when(y > line_y + half, under).otherwise("DOORWAY")


def line_machine(line_y: float, half: float, cfg: LineConfig) -> scan.Automaton:
    """The counter as an automaton over a track's rows (anchor_y and first_y, the track's first). A state is (side, boarded, alighted, zone, its run, side of the line before)."""
    stable = max(cfg.stable_samples, 1)

    def happens(state: tuple, zone: str, run: int, crossed: bool, moved_in: bool, moved_out: bool) -> str | None:
        side, boarded, alighted = state[:3]
        if crossed and not boarded and moved_in:
            return "BOARD"
        if run < stable:
            return None
        if (alighted and zone == "INSIDE") or (boarded and zone == "OUTSIDE"):
            return "UNDO"
        far = {"BOARD": moved_in or side != "UNKNOWN", "EXIT": moved_out}
        what = STABLE.get((side, zone))
        return what if far.get(what, True) else SHORT[side, zone]

    def step(state: tuple, symbol: tuple) -> tuple[tuple, tuple[int, int]]:
        side, boarded, alighted, held, run, before = state
        zone, place, moved_in, moved_out = symbol
        run = min(run + 1, stable) if zone == held else 1
        toward = -1 if cfg.inside_on_top else 1
        crossed = cfg.center_crossing and before is not None and before * toward <= 0 < place * toward
        what = happens(state, zone, run, crossed, moved_in, moved_out)
        counted = (0, 0)
        if what == "UNDO":
            counted = (0, -1) if alighted and zone == "INSIDE" else (-1, 0)
            side, boarded, alighted = (zone, boarded, False) if counted[1] else (zone, False, alighted)
        elif what == "BOARD":
            if not boarded:
                side, boarded, alighted, counted = "BOARDED", True, False, (1, 0)
        elif what == "EXIT":
            if not alighted:
                side, boarded, alighted, counted = "ALIGHTED", False, True, (0, 1)
        elif what is not None:
            side = what
        return (side, boarded, alighted, zone, run, place if cfg.center_crossing else None), counted

    places = (-1, 0, 1) if cfg.center_crossing else (0,)
    alphabet = list(product(SIDES, places, (False, True), (False, True)))

    def symbols(rows: pa.Table) -> np.ndarray:
        y, first = (rows.column(c).to_numpy() for c in ("anchor_y", "first_y"))
        above, under = (0, 1) if cfg.inside_on_top else (1, 0)
        zone = np.where(y < line_y - half, above, np.where(y > line_y + half, under, 2))
        inward = (first - y) if cfg.inside_on_top else (y - first)
        place = np.sign(y - line_y).astype(np.int64) + 1 if cfg.center_crossing else 0
        return ((zone * len(places) + place) * 2 + (inward >= cfg.min_move_px)) * 2 + (-inward >= cfg.min_move_px)

    return scan.Automaton(("UNKNOWN", False, False, "", 0, None), alphabet, step, symbols)


def line_tracks(samples: DataFrame, line_y: float, half: float, cfg: LineConfig, stretch: int = scan.STRETCH, fan: int = scan.FAN) -> DataFrame:
    """session_id, track_id, boardings, alightings, state at the end. Samples are taken by frame and, where they have it, ``seq``."""
    seq = F.col("seq") if "seq" in samples.columns else F.lit(0)
    rows = scan.with_stretch(samples.select(*TRACK, "frame_index", seq.alias("seq"), F.col("anchor_y").cast("double").alias("anchor_y")), "frame_index", stretch)
    ends = rows.groupBy(*TRACK, "_stretch").agg(F.min(F.struct("frame_index", "seq", "anchor_y")).alias("_f"))
    firsts = ends.select(*TRACK, "_stretch", F.min("_f").over(Window.partitionBy(*TRACK))["anchor_y"].alias("first_y"))
    machine = line_machine(line_y, half, cfg)
    states = scan.final_states(rows.join(firsts, [*TRACK, "_stretch"]), list(TRACK), ["frame_index", "seq"], machine, fan)
    names = F.array(*[F.lit(s[0]) for s in machine.states])
    end = states.withColumn("_s", F.from_json("state", "array<string>"))
    counts = F.from_json(F.get("_s", 1), "array<int>")
    return end.select(*TRACK, F.get(counts, 0).alias("boardings"), F.get(counts, 1).alias("alightings"), F.get(names, F.get("_s", 0).cast("int")).alias("state"))


def line_counts(samples: DataFrame, line_y: float, half: float, cfg: LineConfig) -> DataFrame:
    """boardings and alightings of each session, cancelled ones taken out."""
    return line_tracks(samples, line_y, half, cfg).groupBy("session_id").agg(F.sum("boardings").alias("boardings"), F.sum("alightings").alias("alightings"))
