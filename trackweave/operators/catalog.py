"""Files: listing, place in their life, root, and which were analysed before."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


#: Folders below a root that listings go down; those that sample scans go down.
LIST_DEPTH, SAMPLE_DEPTH = 8, 6
#: Bytes of a table of roots that is broadcast at most.
ROOTS_BYTES = 8 << 20


def below(path, root) -> F.Column:
    """The path below a root that it lies under."""
    return F.array_join(F.slice(P.segments(path), F.size(P.segments(root)) + 1, 1 << 20), "/")


def videos(files: DataFrame, roots: DataFrame, depth: int = LIST_DEPTH) -> DataFrame:
    """Video files (path, size, modified_ms) under roots (root, kind, priority), newest first: place, flags, issue, metadata.

    A file belongs to its most specific root, and must lie at most ``depth`` levels below it.
    """
    rows = deepest_root(files.where(P.is_video(F.col("path"))), roots).where("root is not null")
    rows = rows.where(F.size(P.segments(F.col("path"))) - F.size(P.segments(F.col("root"))) <= depth)
    # What is told of a file comes behind the sort: before it, it would be shuffled, and computed once more for the sample of the ranges.
    rows = rows.orderBy(F.col("modified_ms").desc(), "path").withColumn("below_root", below(F.col("path"), F.col("root")))
    rows = rows.withColumn("location", P.storage_location(F.col("kind"), F.col("below_root"))).withColumns(P.video_metadata(F.col("path")))
    rows = rows.withColumn("folder", P.location_flag(F.col("location"), 0)).withColumn("modified", P.file_time(F.col("modified_ms")))
    shown = P.location_flag(F.col("location"), 1)
    rows = rows.withColumn("can_preview", (F.col("size") > 0) & shown).withColumn("can_analyse", (F.col("size") > 0) & P.location_flag(F.col("location"), 2))
    issue = F.when(F.col("size") <= 0, P.EMPTY_FILE).when(~shown, P.NOT_COMPLETE)
    return rows.withColumn("issue", issue)


def preview_answers(requests: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """What a request for a preview (path) is answered, as a status: 400 outside the roots or no video, 404 missing, 422 empty, 409 not complete yet, 200."""
    held = files.select("path", "size").hint("merge")  # as long as the requests are: never broadcast, whatever its size is estimated at
    rows = deepest_root(requests.select("path").distinct().join(held, "path", "left"), roots)
    shown = P.location_flag(P.storage_location(F.col("kind"), below(F.col("path"), F.col("root"))), 1)
    status = F.when(F.col("root").isNull(), 400).when(F.col("size").isNull(), 404).when(~P.is_video(F.col("path")), 400).when(F.col("size") <= 0, 422).when(~shown, 409).otherwise(200)
    return rows.select("path", status.alias("status"))


def sample_videos(files: DataFrame, root: str, recorder: str, camera: str | None = None, depth: int = SAMPLE_DEPTH) -> DataFrame:
    """A recorder's files at most ``depth`` levels below a root whose path doesn't hold the word incoming, newest first."""
    top = len([x for x in root.split("/") if x])
    here = F.col("path").startswith(root.rstrip("/") + "/") & (F.size(P.segments(F.col("path"))) - top <= depth)
    rows = files.where(P.is_video(F.col("path")) & ~F.col("path").contains("incoming") & here)
    rows = rows.withColumns(P.video_metadata(F.col("path"))).where(F.col("video_device_id") == recorder)
    if camera is not None:
        rows = rows.where(F.col("camera_code") == camera)
    return rows.orderBy(F.col("modified_ms").desc(), "path")


def deepest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file's most specific root (root, kind, priority): the longest path prefix, ties by priority.

    The prefix of each length that a root has is joined by equality, so no file meets every root, and a file's row is neither multiplied nor grouped.
    Roots of up to ``ROOTS_BYTES`` are broadcast: else the files would be shuffled by prefixes of which there are few, most of them into one task.
    """
    depth = lambda parts: F.greatest(F.size(parts), F.lit(1))
    own = roots.where("root is not null").groupBy("root").agg(F.min_by("kind", F.struct(F.col("priority").isNull(), "priority", "kind")).alias("kind"))
    deepest, size = own.agg(F.max(depth(P.segments(F.col("root")))), F.sum(64 + F.octet_length("root") + F.coalesce(F.octet_length("kind"), F.lit(0)))).first()
    place = lambda held: F.broadcast(held) if (size or 0) <= ROOTS_BYTES else held
    rows, found = files.withColumn("_parts", P.segments(F.col("path"))), []
    for n in range(1, (deepest or 0) + 1):
        prefix = F.when(depth(F.col("_parts")) >= n, F.concat(F.when(F.col("path").startswith("/"), "/").otherwise(""), F.array_join(F.slice("_parts", 1, n), "/")))
        level = own.where(depth(P.segments(F.col("root"))) == n).select(F.col("root").alias("_prefix"), F.struct("root", "kind").alias(f"_root_{n}"))
        rows = rows.join(place(level), prefix == F.col("_prefix"), "left").drop("_prefix")
        found.insert(0, f"_root_{n}")
    best = F.coalesce(*found) if found else F.lit(None).cast(own.select(F.struct("root", "kind").alias("r")).schema["r"].dataType)
    return rows.withColumn("_root", best).select(*files.columns, F.col("_root.root").alias("root"), F.col("_root.kind").alias("kind"))


def first_by_root(roots: DataFrame) -> DataFrame:
    """One row for each root: the one of the first priority."""
    place = F.row_number().over(Window.partitionBy("root").orderBy("priority", "kind"))
    return roots.withColumn("_n", place).where("_n = 1").drop("_n")


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def unprocessed(clips: DataFrame, results: DataFrame) -> DataFrame:
    """Clips whose content no stored result has, whatever its status: equal clips count as one, that of the first path."""
    first = clips.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in clips.columns if c != "sha256"]), "path").alias("_r"))
    rows = first.select(*[F.col(c) if c == "sha256" else F.col(f"_r.{c}") for c in clips.columns])
    return rows.join(results.select(F.col("file_sha256").alias("sha256")).where("sha256 is not null"), "sha256", "left_anti").select(*clips.columns)


def unanalysed(clips: DataFrame, results: DataFrame) -> DataFrame:
    """The older rule: clips that no FINISHED result matches by content, by relative path, or by device and uid. Three anti joins."""
    done = results.where("status = 'FINISHED'")
    rows = unmatched(clips, done, ["sha256"], ["file_sha256"])
    rows = unmatched(rows, done, ["relative_path"], ["original_path"])
    return unmatched(rows, done, ["video_device_id", "file_uid"], ["video_device_id", "file_uid"])


def unmatched(rows: DataFrame, others: DataFrame, key: list[str], other_key: list[str]) -> DataFrame:
    """Rows whose key no other row has. A key that holds a null matches nothing; such rows are dealt by all their columns, so that they don't meet in one task."""
    whole = [F.col(c).isNotNull() for c in key]
    spread = F.when(reduce(and_, whole), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns))
    known = others.where(reduce(and_, [F.col(c).isNotNull() for c in other_key])).select(F.struct(F.lit(0).cast("long").alias("spread"), *other_key).alias("_known"))
    asked = rows.withColumn("_asked", F.struct(spread.alias("spread"), *[F.col(c).alias(o) for c, o in zip(key, other_key, strict=True)]))
    return asked.join(known, F.col("_asked") == F.col("_known"), "left_anti").select(*rows.columns)
