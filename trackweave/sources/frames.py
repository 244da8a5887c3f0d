"""Frames of clips as a Python data source: a clip is read in ranges of frames, and the stride, filters on session and frame, and columns without images stay inside the scan.

A clip is a folder of numbered raw frames here (``000012.rgb`` of width x height x 3 bytes beside ``clip.json``), since no video
decoder is at hand; a decoder needs only another ``frame``. ``register`` lets Spark hand filters to Python sources, so that a point read opens one frame's file, and a
read up to a stop frame opens none behind it. With ``headers`` there is a row a clip with its rate, size and number of frames, and no frame is opened.

Clips that are still being recorded are read as a stream: an offset is the next frame of each clip. Whoever finds that a clip may end says so by
``acknowledge``; the clip's offset then stays behind its stop frame, and the stream opens no later frame of it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "session_id string, frame_index int, fps double, width int, height int, image binary"
HEADERS = "session_id string, fps double, width int, height int, n_frames int"
#: Frames of a partition, so that one long clip is many tasks.
FRAMES = 1000
DEFAULT_FPS = 25.0


@dataclass
class Frames(InputPartition):
    """Frames ``first`` to ``last`` of a clip."""

    path: str
    first: int
    last: int


def header(path: str) -> tuple[float, int, int]:
    """Rate, width and height of a clip; a rate that is missing or 0 counts as 25."""
    with open(os.path.join(path, "clip.json")) as f:
        info = json.load(f)
    return float(info.get("fps") or DEFAULT_FPS), info["width"], info["height"]


def frame(path: str, index: int) -> bytes:
    with open(os.path.join(path, f"{index:06d}.rgb"), "rb") as f:
        return f.read()


def frame_numbers(path: str) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in os.listdir(path) if n.endswith(".rgb"))


def clip_rows(part: Frames, step: int) -> Iterator[tuple]:
    """The frames of a range whose number is a multiple of ``step``."""
    session, (fps, width, height) = os.path.basename(part.path), header(part.path)
    for index in frame_numbers(part.path):
        if part.first <= index <= part.last and index % step == 0:
            yield session, index, fps, width, height, frame(part.path, index)


def _put(path: str, value: dict) -> None:
    """Writes a file whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w") as f:
        json.dump(value, f)
    os.replace(temporary, path)


def _get(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)


def acknowledge(ends: DataFrame, folder: str) -> None:
    """Says of each session that its clip may end at ``frame_index``. The smallest of its rows counts; what was said before stays, since a stream may rely on it."""

    def told(rows: Iterator[Row]) -> None:
        for r in rows:
            path = os.path.join(folder, f"{r.session_id}.end.json")
            if not os.path.exists(path):
                _put(path, {"frame_index": r.frame_index})

    ends.where("session_id is not null and frame_index is not null").groupBy("session_id").agg(F.min("frame_index").alias("frame_index")).foreachPartition(told)


class LiveClipReader(DataSourceStreamReader):
    """New frames of all clips of a folder, a clip's in the order of their numbers and at most ``per_trigger`` of them at once.

    A frame counts as landed when all frames of its clip before it have their full size; one that lands behind a later one that was read stays out. ``control`` names a
    folder for acknowledged ends and for the frames that were read, by which a stream that is started again goes on at its own pace. A clip is named
    in the offset once it has a header. Frames between two offsets are always the same, so a batch that is repeated gives the same rows.
    """

    def __init__(self, options: dict):
        self.root, self.step = options["path"], int(options.get("skip", 0)) + 1
        self.size, self.most = max(int(options.get("frames", FRAMES)), 1), max(int(options.get("per_trigger", FRAMES)), 1)
        self.control = options["control"]
        self.next: dict[str, int] = _get(os.path.join(self.control, "read.json"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for session in sorted(os.listdir(self.root)):
            path = os.path.join(self.root, session)
            if os.path.exists(os.path.join(path, "clip.json")):
                self.next[session] = self._landed(path, self.next.get(session, 0), _get(os.path.join(self.control, f"{session}.end.json")).get("frame_index"))
        return dict(self.next)

    def _landed(self, path: str, at: int, end: int | None) -> int:
        """The frame behind the last that can be read now, from ``at`` on."""
        _, width, height = header(path)
        for n, index in enumerate(k for k in frame_numbers(path) if k >= at):
            whole = os.path.getsize(os.path.join(path, f"{index:06d}.rgb")) == width * height * 3
            if not whole or n == self.most or (end is not None and index > end):
                break
            at = index + 1
        return at

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        out: list[Frames] = []
        for session, behind in sorted(end.items()):
            first = start.get(session, 0)
            out += [Frames(os.path.join(self.root, session), k, min(k + self.size, behind) - 1) for k in range(first, behind, self.size)]
        return out

    def read(self, partition: Frames) -> Iterator[tuple]:
        return clip_rows(partition, self.step)

    def commit(self, end: dict) -> None:
        _put(os.path.join(self.control, "read.json"), end)


class ClipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.step = options["path"], int(options.get("skip", 0)) + 1
        self.size, self.headers = max(int(options.get("frames", FRAMES)), 1), options.get("headers", "false").lower() == "true"
        self.first, self.last, self.sessions = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on session_id and frame_index; gives back the others."""
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        if column == ("session_id",) and isinstance(f, EqualTo | In):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.sessions = wanted if self.sessions is None else self.sessions & wanted
            return True
        if column != ("frame_index",) or self.headers:
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            most = f.value - isinstance(f, LessThan)
            self.last = most if self.last is None else min(self.last, most)
        return isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)

    def partitions(self) -> list[Frames]:
        clips = [d for d in sorted(os.listdir(self.root)) if (self.sessions is None or d in self.sessions) and os.path.exists(os.path.join(self.root, d, "clip.json"))]
        out: list[Frames] = []
        for path in (os.path.join(self.root, d) for d in clips):
            if self.headers:
                out.append(Frames(path, 0, -1))
                continue
            numbers = [n for n in frame_numbers(path) if n >= self.first and (self.last is None or n <= self.last)]
            out += [Frames(path, numbers[k], numbers[min(k + self.size, len(numbers)) - 1]) for k in range(0, len(numbers), self.size)]
        return out or [Frames("", 0, -1)]

    def read(self, partition: Frames) -> Iterator[tuple]:
        if not partition.path:
            return
        if self.headers:
            numbers = frame_numbers(partition.path)
            yield os.path.basename(partition.path), *header(partition.path), numbers[-1] + 1 if numbers else 0
            return
        yield from clip_rows(partition, self.step)


class ClipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> ClipReader:
        return ClipReader(self.options)

    def streamReader(self, schema) -> LiveClipReader:
        return LiveClipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ClipSource)
