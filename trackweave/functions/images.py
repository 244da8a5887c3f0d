"""Functions over raw images (rows of RGB bytes): signatures, crops and detector inputs, as Arrow-batched functions.

Images come as (image binary, width int, height int), as the clip source yields them. Pixels are taken by their nearest neighbour.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a signature on each side; the sides of an appearance crop; the grey of a letterbox's padding.
GRID, CROP_W, CROP_H, PAD_GREY = 24, 128, 256, 114
# Channel means and deviations of the appearance model's training images, weights of a pixel's brightness.
MEAN, SPREAD, LUMA = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), (0.2126, 0.7152, 0.0722)


def pixels(image: bytes, width: int, height: int) -> np.ndarray:
    """Rows x columns x RGB."""
    return np.frombuffer(image, np.uint8)[: width * height * 3].reshape(height, width, 3)


def points_inside(x: np.ndarray, y: np.ndarray, polygon: list[tuple[float, float]]) -> np.ndarray:
    """Even-odd rule for many points."""
    out = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(polygon, polygon[-1:] + polygon[:-1], strict=True):
        rise = by - ay if abs(by - ay) > 1e-7 else 1e-7
        out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax)
    return out


def grid_signature(image: np.ndarray, polygon: list[tuple[float, float]], cells: int = GRID) -> list[float | None]:
    """Brightness at the middle of each cell of a grid over a polygon's bounding box, None outside the polygon; not yet normalised."""
    height, width = image.shape[:2]
    if len(polygon) < 3 or width <= 1 or height <= 1:
        return [None] * (cells * cells)
    low_x, high_x, low_y, high_y = (min(max(v, 0.0), 1.0) for k in (0, 1) for v in (min(p[k] for p in polygon), max(p[k] for p in polygon)))
    middle = (np.arange(cells) + 0.5) / cells
    x, y = np.tile(low_x + middle * (high_x - low_x), cells), np.repeat(low_y + middle * (high_y - low_y), cells)
    held = points_inside(x, y, polygon)
    column, row = (np.clip((v * (n - 1)).astype(int), 0, n - 1) for v, n in ((x, width), (y, height)))
    light = image[row, column].astype(float) @ np.array(LUMA) / 255.0
    return [float(v) if h else None for v, h in zip(light, held, strict=True)]


def _batched(kind: str, dtype: pa.DataType, f):
    """An Arrow function of columns; ``f`` gets one row's values, and null rows give null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*[c.to_pylist() for c in columns], strict=True)
            yield pa.array([None if any(v is None for v in row) else f(*row) for row in rows], dtype)

    return run


def signature(image: Column, width: Column, height: Column, polygon: Column) -> Column:
    """The signature of a polygon (an array of points in shares of the frame)."""
    f = lambda i, w, h, p: grid_signature(pixels(i, w, h), [(q["x"], q["y"]) for q in p])
    return _batched("array<double>", pa.list_(pa.float64()), f)(image, width, height, polygon)


def _resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    return image[np.arange(height) * h // height][:, np.arange(width) * w // width]


def letterboxed(image: np.ndarray, side: int) -> np.ndarray:
    """A detector's input: the image scaled into a grey square, as RGB planes from 0 to 1."""
    h, w = image.shape[:2]
    gain = min(side / w, side / h)
    new_w, new_h = int(w * gain), int(h * gain)
    out = np.full((side, side, 3), PAD_GREY, np.uint8)
    left, top = (side - new_w) // 2, (side - new_h) // 2
    if new_w and new_h:
        out[top : top + new_h, left : left + new_w] = _resized(image, new_w, new_h)
    return (out.transpose(2, 0, 1) / np.float32(255)).astype(np.float32)


def letterbox_input(image: Column, width: Column, height: Column, side: int) -> Column:
    f = lambda i, w, h: letterboxed(pixels(i, w, h), side).ravel()
    return _batched("array<float>", pa.list_(pa.float32()), f)(image, width, height)


def crop(image: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray | None:
    """A box widened by a tenth of its width and a twentieth of its height on each side, as an appearance model's normalised input; None under 10 x 10 pixels."""
    h, w = image.shape[:2]
    dx, dy = (box[2] - box[0]) * 0.10, (box[3] - box[1]) * 0.05
    raw = box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy
    if raw[2] <= 0 or raw[3] <= 0 or raw[0] >= w or raw[1] >= h:
        return None
    x1, y1 = min(max(int(raw[0]), 0), w - 1), min(max(int(raw[1]), 0), h - 1)
    x2, y2 = min(max(int(raw[2]), x1 + 1), w), min(max(int(raw[3]), y1 + 1), h)
    if x2 - x1 < 10 or y2 - y1 < 10:
        return None
    part = _resized(image[y1:y2, x1:x2], CROP_W, CROP_H) / np.float32(255)
    return ((part - np.float32(MEAN)) / np.float32(SPREAD)).transpose(2, 0, 1).astype(np.float32)


def appearance_input(image: Column, width: Column, height: Column, box: Column) -> Column:
    """Crops of a box (a struct of corners) as inputs of the appearance model."""

    def f(i, w, h, b):
        found = crop(pixels(i, w, h), (b["x1"], b["y1"], b["x2"], b["y2"]))
        return None if found is None else found.ravel()

    return _batched("array<float>", pa.list_(pa.float32()), f)(image, width, height, box)


def jpeg_text(image: bytes, width: int, height: int, quality: float, widest: int = 800) -> str:
    """An image as base64 text of a JPEG, at most ``widest`` pixels wide. Needs the Pillow library."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("JPEG previews need the Pillow library") from e
    picture = pixels(image, width, height)
    if width > widest:
        picture = _resized(picture, widest, int(height * widest / width))
    out = io.BytesIO()
    Image.fromarray(picture).save(out, "JPEG", quality=round(quality * 100))
    return base64.b64encode(out.getvalue()).decode()


def jpeg(image: Column, width: Column, height: Column, quality: float = 0.45) -> Column:
    return _batched("string", pa.string(), lambda i, w, h: jpeg_text(i, w, h, quality))(image, width, height)
