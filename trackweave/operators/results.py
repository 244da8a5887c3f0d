"""Stored results: filtered, paged search, lookups, and the projection that callers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_time() -> Column:
    return F.coalesce("clip_started_ms", "finished_ms")


def search(results: DataFrame, device: str | None = None, status: str | None = None, event_code: str | None = None, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Rows that match all given values; blank ones aren't given. Times are inclusive. Omitted filters aren't in the plan, so the others reach the scan."""
    given = {"video_device_id": device, "status": status, "event_code": event_code}
    for column, value in given.items():
        if value is not None and value.strip():
            results = results.where(F.col(column) == value.strip())
    if from_ms is not None:
        results = results.where(effective_time() >= from_ms)
    if to_ms is not None:
        results = results.where(effective_time() <= to_ms)
    return results


def page(results: DataFrame, number: int = 0, size: int = 20) -> DataFrame:
    """A page by finishing time, newest first; session ids break ties."""
    return results.orderBy(F.col("finished_ms").desc_nulls_last(), "session_id").offset(number * size).limit(size)


def page_count(results: DataFrame, size: int = 20) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))


def by_device(results: DataFrame, device: str) -> DataFrame:
    return results.where(F.col("video_device_id") == device).orderBy(effective_time().desc_nulls_last(), "session_id")


def lookup(results: DataFrame, session: str) -> DataFrame:
    return results.where(F.col("session_id") == session).limit(1)


def response(results: DataFrame, line: tuple[float, float, float, float] = (0.0, 0.5, 1.0, 0.5)) -> DataFrame:
    """What callers see: exits are the greater of both counts, boardings 0, the camera is the channel or else the event code."""
    rows = results.select(
        "session_id", "status", "video_device_id", F.coalesce(F.col("channel").cast("string"), "event_code").alias("camera_code"),
        F.greatest(F.coalesce("exited", F.lit(0)), F.coalesce("alightings", F.lit(0))).alias("exited"), F.lit(0).alias("boardings"), "onboard",
        effective_time().alias("at_ms"),
    )
    return rows.withColumns({f"line_{k}": F.lit(v) for k, v in zip(("x1", "y1", "x2", "y2"), line, strict=True)})


def text_filter(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows that hold the text, case aside, in one of the columns."""
    joined = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in columns]))
    return rows.where(joined.contains(text.strip().lower())) if text.strip() else rows


def upsert(old: DataFrame, new: DataFrame, key: str, by: str) -> DataFrame:
    """Rows of both, one for each key: the newest of the new ones, else the old."""
    from .door_config import latest

    fresh = latest(new, [key], by)
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
