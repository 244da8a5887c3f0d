"""Boxes, points and polygons as Catalyst expressions, and the few polygon builders that run on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BoxConfig


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def anchor(b: Column, rx: float, ry: float) -> tuple[Column, Column]:
    """The point of a box at the given shares of its sides, which are held within 0 and 1."""
    rx, ry = min(max(rx, 0.0), 1.0), min(max(ry, 0.0), 1.0)
    return b["x1"] + width(b) * rx, b["y1"] + height(b) * ry


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    common = w * h
    total = width(a) * height(a) + width(b) * height(b) - common
    return F.when((w > 0) & (h > 0) & (total > 0), common / total).otherwise(F.lit(0.0))


def center_distance(a: Column, b: Column) -> Column:
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule: an odd number of edges is crossed by the ray to the right. Fewer than three points hold nothing.

    A count of crossings, so no accumulator is carried; a bounding box spares most points the edges.
    """
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, (i + n - 1) % n)
        rise = b["y"] - a["y"]
        rise = F.when(F.abs(rise) < 1e-6, F.when(rise < 0, -1e-6).otherwise(1e-6)).otherwise(rise)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"])

    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    near = (x >= F.array_min(xs)) & (x <= F.array_max(xs)) & (y >= F.array_min(ys)) & (y <= F.array_max(ys))
    odd = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1
    return F.when((n >= 3) & near, odd).otherwise(F.lit(False))


def zone_label(x: Column, y: Column, salon: Column, street: Column) -> Column:
    """INSIDE in the salon only, OUTSIDE in the street only, BUFFER in both or neither."""
    return label(point_in_polygon(x, y, salon), point_in_polygon(x, y, street))


def label(in_salon: Column, in_street: Column) -> Column:
    return F.when(in_salon & ~in_street, "INSIDE").when(in_street & ~in_salon, "OUTSIDE").otherwise("BUFFER")


def clean_polygon(polygon: Column) -> Column:
    """Points held within the unit square; fewer than three points, or null, give an empty polygon."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    held = F.transform(polygon, lambda p: F.struct(clamp(p["x"]).alias("x"), clamp(p["y"]).alias("y")))
    return F.when(F.size(polygon) >= 3, held).otherwise(F.array().cast("array<struct<x: double, y: double>>"))


def head_region(b: Column, frame_width: Column, frame_height: Column, cfg: BoxConfig) -> Column:
    """The head at the top centre of a person box: shares of its sides, a least size, inside the frame."""
    h = F.least(F.greatest(height(b) * cfg.head_height, F.lit(cfg.head_min_px)), height(b))
    w = F.least(F.greatest(width(b) * cfg.head_width, F.lit(cfg.head_min_px)), width(b))
    middle = (b["x1"] + b["x2"]) / 2
    return _inside(middle - w / 2, b["y1"], middle + w / 2, b["y1"] + h, frame_width, frame_height)


def synthetic_body(b: Column, frame_width: Column, frame_height: Column, cfg: BoxConfig) -> Column:
    """A body below a head box: so many head widths and heights, the top fixed, inside the frame."""
    middle = (b["x1"] + b["x2"]) / 2
    w, h = width(b) * cfg.body_widths, height(b) * cfg.body_heights
    return _inside(middle - w / 2, b["y1"], middle + w / 2, b["y1"] + h, frame_width, frame_height)


def _inside(x1: Column, y1: Column, x2: Column, y2: Column, fw: Column, fh: Column) -> Column:
    hold = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    return box(hold(x1, fw), hold(y1, fh), hold(x2, fw), hold(y2, fh))


def too_large_for_head(b: Column, fw: Column, fh: Column, cfg: BoxConfig) -> Column:
    w, h = width(b) / F.greatest(fw, F.lit(1)), height(b) / F.greatest(fh, F.lit(1))
    return (w > cfg.max_width) | (h > cfg.max_height) | (w * h > cfg.max_area)


def in_corner_mask(b: Column, fw: Column, fh: Column, cfg: BoxConfig) -> Column:
    """Whether a box lies in the masked left-top corner, by its centre or by a share of its area."""
    if cfg.mask_x <= 0 or cfg.mask_y <= 0:
        return F.lit(False)
    right, bottom = F.greatest(fw, F.lit(1)) * min(cfg.mask_x, 1.0), F.greatest(fh, F.lit(1)) * min(cfg.mask_y, 1.0)
    center = ((b["x1"] + b["x2"]) / 2 <= right) & ((b["y1"] + b["y2"]) / 2 <= bottom)
    w = F.least(b["x2"], right) - F.greatest(b["x1"], F.lit(0.0))
    h = F.least(b["y2"], bottom) - F.greatest(b["y1"], F.lit(0.0))
    common = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    return center | (common / F.greatest(width(b) * height(b), F.lit(1.0)) >= cfg.mask_share)


def from_letterbox(b: Column, scale: Column, pad_x: Column, pad_y: Column, fw: Column, fh: Column) -> Column:
    """A box of the padded, scaled input in coordinates of the frame, held inside it."""
    return _inside((b["x1"] - pad_x) / scale, (b["y1"] - pad_y) / scale, (b["x2"] - pad_x) / scale, (b["y2"] - pad_y) / scale, fw, fh)


def upscale(fw: Column, fh: Column, least: int = 480) -> Column:
    """The factor that brings a frame's shorter side to ``least``; 1 if it is that long already."""
    return F.when(F.least(fw, fh) < least, F.lit(float(least)) / F.least(fw, fh)).otherwise(1.0)


# On the driver: zones are one small row for each session.


def clip_half_plane(points: list[tuple[float, float]], a: tuple[float, float], b: tuple[float, float], keep_left: bool, eps: float = 1e-4) -> list[tuple[float, float]]:
    """The part of a polygon on one side of the line through ``a`` and ``b``."""

    def side(p: tuple[float, float]) -> float:
        value = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        return value if keep_left else -value

    out: list[tuple[float, float]] = []
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        s, t = side(p), side(q)
        if s >= -eps:
            out.append(p)
        if (s > eps and t < -eps) or (s < -eps and t > eps):
            k = s / (s - t)
            out.append((p[0] + (q[0] - p[0]) * k, p[1] + (q[1] - p[1]) * k))
    return out


def default_door(a: tuple[float, float], b: tuple[float, float], width: float, height: float) -> list[tuple[float, float]]:
    """A door around the middle of a line, in pixels: 35 % of the line wide, within 8 % and 28 % of the frame; 22 % of the frame high, from 90 px to 45 %."""
    mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    w = min(max(math.hypot(b[0] - a[0], b[1] - a[1]) * 0.35, width * 0.08), width * 0.28) / 2
    h = min(max(height * 0.22, 90.0), height * 0.45) / 2
    x0, x1 = (min(max(x, 0.0), width) for x in (mx - w, mx + w))
    y0, y1 = (min(max(y, 0.0), height) for y in (my - h, my + h))
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def line_door(ax: Column, ay: Column, bx: Column, by: Column, fw: Column, fh: Column) -> Column:
    """``default_door`` of a line in shares of the frame, as a column: the door's corners x1, y1, x2, y2 in shares of the frame."""
    hold = lambda v, low, high: F.least(F.greatest(v, low), high)
    zero, one = F.lit(0.0), F.lit(1.0)
    ax, bx = (hold(v, zero, one) * fw for v in (ax, bx))
    ay, by = (hold(v, zero, one) * fh for v in (ay, by))
    w = hold(F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) * 0.35, fw * 0.08, fw * 0.28) / 2
    h = hold(fh * 0.22, F.lit(90.0), fh * 0.45) / 2
    mx, my = (ax + bx) / 2, (ay + by) / 2
    return box(hold(mx - w, zero, fw.cast("double")) / fw, hold(my - h, zero, fh.cast("double")) / fh, hold(mx + w, zero, fw.cast("double")) / fw, hold(my + h, zero, fh.cast("double")) / fh)


def zones_from_line(a: tuple[float, float], b: tuple[float, float], width: float, height: float, inside_below: bool = True) -> dict[str, list[tuple[float, float]]]:
    """Salon and street, the two parts of a frame beside a line, and the default door, all in shares of the frame. The line is in shares, too; sizes are in pixels."""
    frame = [(0.0, 0.0), (width, 0.0), (width, height), (0.0, height)]
    if a[0] > b[0]:
        a, b = b, a
    a, b = ((min(max(x, 0.0), 1.0) * width, min(max(y, 0.0), 1.0) * height) for x, y in (a, b))
    parts = {"salon": clip_half_plane(frame, a, b, inside_below), "street": clip_half_plane(frame, a, b, not inside_below), "door": default_door(a, b, width, height)}
    return {k: [(min(max(x / width, 0.0), 1.0), min(max(y / height, 0.0), 1.0)) for x, y in points] for k, points in parts.items()}
