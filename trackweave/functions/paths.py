"""What file paths and names tell: device, date, camera, clip times, storage, safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of clips, and of those that are taken in without being uploaded.
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "flv", "wmv", "webm", "m4v")
INGEST_EXTENSIONS = ("avi", "mp4", "mov", "mkv", "m4v")
# Places by code, with their labels and whether previews and analyses are allowed there; texts of issues.
LOCATIONS = {
    "MANUAL": ("Видео", True, True),
    "CHANNEL_PREVIEW": ("Превью канала", True, False),
    "FTP_INCOMING": ("FTP / входящие", False, False),
    "FTP_NEEDS_CLASSIFICATION": ("FTP / ожидает дверь", True, False),
    "FTP_FINISHED": ("FTP / обработано", True, True),
    "FTP_FAILED": ("FTP / ошибка", True, True),
    "FTP_STOPPED": ("FTP / остановлено", True, True),
    "FTP_PROCESSED": ("FTP / processed", True, True),
}
EMPTY_FILE, NOT_COMPLETE = "Пустой файл", "Загрузка ещё не завершена"


def segments(path: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(path, r"\\", "/"), "/"), "")


def device_index(path: Column) -> Column:
    """The place, from 0, of the first all-digit segment that a date follows; null if there is none."""
    parts = segments(path)
    here = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda i: F.coalesce(F.get(parts, i).rlike("^[0-9]{1,64}$") & F.get(parts, i + 1).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)),
    )
    return F.get(here, 0)


def video_metadata(path: Column) -> dict[str, Column]:
    """Columns by name: what the path holds, null where a part is missing or of another type."""
    parts, at = segments(path), device_index(path)
    name = F.element_at(parts, -1)
    fields = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    number = lambda k, kind: F.get(fields, k).try_cast(kind)
    return {
        "video_device_id": F.get(parts, at),
        "record_date": F.get(parts, at + 1).try_cast("date"),
        "relative_path": F.when(at.isNotNull(), F.array_join(F.slice(parts, at + 1, F.size(parts)), "/")),
        "channel": number(0, "int"),
        "camera_code": number(0, "int").cast("string"),
        "event_code": F.when(F.trim(F.get(fields, 1)) != "", F.get(fields, 1)),
        "record_type": number(2, "int"),
        "clip_started_at": F.timestamp_seconds(number(3, "bigint")),
        "clip_finished_at": F.timestamp_seconds(number(4, "bigint")),
        "file_flag": number(5, "int"),
        "file_uid": number(6, "bigint"),
    }


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def safe_segment(text: Column, default: str = "unknown", most: int = 80) -> Column:
    """A name that is safe in a path; blank or null gives ``default``."""
    named = F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))
    return F.substring(F.regexp_replace(named, "[^A-Za-z0-9._-]", "_"), 1, most)


def clock_text(frame_index: Column, fps: Column) -> Column:
    """Minutes and seconds of a frame, as mm:ss; frame rates that are null or not above 0 count as 25."""
    rate = F.when(fps > 0, fps).otherwise(25.0)
    seconds = F.floor(frame_index / rate)
    return F.concat(F.lpad((seconds / 60).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def storage_location(kind: Column, relative: Column) -> Column:
    """A file's place in its life, by the kind of its root (FTP_INCOMING, FTP_PROCESSED, VIDEOS) and the first folder below it."""
    first = F.lower(F.get(segments(relative), 0))
    done = F.when(first == "needs-classification", "FTP_NEEDS_CLASSIFICATION").when(first == "finished", "FTP_FINISHED").when(first == "failed", "FTP_FAILED").when(first == "stopped", "FTP_STOPPED").otherwise("FTP_PROCESSED")
    manual = F.when(first == "classification", "CHANNEL_PREVIEW").otherwise("MANUAL")
    return F.when(kind == "FTP_INCOMING", "FTP_INCOMING").when(kind == "FTP_PROCESSED", done).when(kind == "VIDEOS", manual)


def location_flag(code: Column, which: int) -> Column:
    """The label (0) of a place, or whether previews (1) or analyses (2) are allowed there."""
    pairs = [F.lit(x) for name, values in LOCATIONS.items() for x in (name, values[which])]
    return F.element_at(F.create_map(*pairs), code)


def file_time(modified_ms: Column) -> Column:
    """When a file was changed, as dd.MM.yy HH:mm in the session's time zone."""
    return F.date_format(F.timestamp_millis(modified_ms), "dd.MM.yy HH:mm")


def inside_home(path: Column, home: str) -> Column:
    """Whether a path lies under ``home`` once its '.' and '..' segments are taken out; a path above the root never does."""
    parts = segments(path)
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when((x == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.array_append(a, x)))
    top = [x for x in home.replace("\\", "/").split("/") if x]
    return ~F.array_contains(folded, "..") & (F.slice(folded, 1, len(top)) == F.array(*[F.lit(x) for x in top])) & (F.size(folded) > len(top)) if top else ~F.array_contains(folded, "..")


def in_device_layout(path: Column, root: str) -> Column:
    """Whether a file lies below ``<digits>/<yyyy-MM-dd>/`` of a root, and in no folder named processed."""
    depth = len([x for x in root.split("/") if x])
    parts = F.slice(segments(path), depth + 1, 1 << 20)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    fits = F.get(parts, 0).rlike("^[0-9]{1,64}$") & F.get(parts, 1).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.get(parts, 1).try_cast("date").isNotNull()
    return F.coalesce((F.size(parts) >= 3) & fits & ~F.exists(folders, lambda x: F.lower(x) == "processed"), F.lit(False))


def logical_door(text: Column, known: tuple[str, ...]) -> Column:
    """A door's name in capitals; an unknown one raises an error."""
    name = F.upper(F.trim(text))
    return F.when(name.isin(*known) | name.isNull(), name).otherwise(F.raise_error(F.concat(F.lit("unknown logical door: "), name)))


def points_from_json(text: Column) -> Column:
    """A polygon from JSON text; bad text gives an empty one."""
    kind = "array<struct<x: double, y: double>>"
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def points_to_json(points: Column) -> Column:
    """A polygon as JSON text, its points held within the unit square; a null polygon gives []."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    held = F.transform(points, lambda p: F.struct(clamp(p["x"]).alias("x"), clamp(p["y"]).alias("y")))
    return F.coalesce(F.to_json(held), F.lit("[]"))
