"""Doors: which camera shows which, with which zones. Bindings keep their history; one per camera is active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import logical_door
from ..schemas import DOOR_NAMES

CAMERA = ["recorder_id", "camera_code"]


def resolve(clips: DataFrame, bindings: DataFrame, profiles: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Each clip's active binding and its profile; missing or empty polygons fall back to the defaults.

    Cameras marked IGNORE or NEEDS_CLASSIFICATION get the defaults whatever profile they name. The newest active binding wins where data hold several. Both sides are left joins on equal keys; Spark broadcasts them where they are small.
    """
    active = latest(bindings.where("active"), CAMERA, "updated_ms").select(*CAMERA, "logical_door", "profile_id")
    known = profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"), *defaults)
    unused = F.col("logical_door").isin("IGNORE", "NEEDS_CLASSIFICATION")
    active = active.withColumn("profile_id", F.when(~unused, F.col("profile_id"))).withColumn("_bound", F.lit(True))
    known = known.withColumn("_known", F.lit(True))
    rows = clips.join(active, CAMERA, "left").join(known, "profile_id", "left")
    given = lambda c: F.when(F.trim(F.col(c)).isin("", "[]"), None).otherwise(F.col(c))
    return rows.select(
        *clips.columns, "logical_door", F.coalesce(F.col("logical_door") == "IGNORE", F.lit(False)).alias("ignored"), F.coalesce(F.col("logical_door") == "NEEDS_CLASSIFICATION", F.lit(False)).alias("classification_needed"),
        F.when(F.col("_known"), F.col("profile_id")).alias("profile_id"), F.when(F.col("_known"), F.col("profile_name")).otherwise("application-default").alias("profile_name"),
        F.when(F.col("_known"), "DATABASE").when(F.col("_bound"), "BINDING_DEFAULT").otherwise("APPLICATION_DEFAULT").alias("source"), *[F.coalesce(given(c), F.lit(v)).alias(c) for c, v in defaults.items()],
    )


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key; ties go to the greater row."""
    others = [c for c in rows.columns if c not in keys and c != by]
    best = rows.groupBy(*keys).agg(F.max(F.struct(by, *others)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])


def channels(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """All cameras that are bound or have sample files, with both sides where they exist."""
    bound = bindings.where("active").select("recorder_id", "camera_code", "logical_door")
    found = files.groupBy("recorder_id", "camera_code").agg(F.count(F.lit(1)).alias("samples"), F.max("modified_ms").alias("newest_ms"))
    rows = bound.join(found, CAMERA, "full_outer")
    return rows.select(*CAMERA, F.coalesce("logical_door", F.lit("NEEDS_CLASSIFICATION")).alias("logical_door"), F.coalesce("samples", F.lit(0)).alias("samples"), "newest_ms")


def camera_keys(*tables: DataFrame) -> DataFrame:
    """All cameras (recorder_id, camera_code) of some tables, blank codes left out, in order."""
    keys = [t.select(*CAMERA) for t in tables]
    rows = keys[0]
    for other in keys[1:]:
        rows = rows.union(other)
    return rows.where(F.trim("camera_code") != "").distinct().orderBy(*CAMERA)


def of_recorder(bindings: DataFrame, recorder: str) -> DataFrame:
    """A recorder's active bindings by camera, the newest of each camera first."""
    rows = bindings.where((F.col("recorder_id") == recorder.strip()) & F.col("active"))
    return rows.orderBy("camera_code", F.col("updated_ms").desc(), "id")


def listed(bindings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bindings with profile names: unclassified ones first, then by recorder, camera, newest."""
    names = profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile_name"))
    rows = bindings.join(names, "profile_id", "left")
    return rows.orderBy((F.col("logical_door") == "NEEDS_CLASSIFICATION").desc(), *CAMERA, F.col("updated_ms").desc(), "id")


def profiles_by_name(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.lower("name"), "id")


class NoSuchBinding(KeyError):
    """There is no binding of this id."""


def new_id(*parts) -> F.Column:
    """An id derived from a row's own values, so that rows needn't be numbered in one place."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def bind(bindings: DataFrame, requests: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """All bindings after requests (recorder_id, camera_code, logical_door, profile_id, at_ms): the active one of a requested camera is closed, a new one opened.

    Where bindings have the columns confirmed_by, preview_path and preview_frame, requests may give them; confirmed_ms and
    created_ms are the request's time. Blank recorders and cameras raise an error, and, if ``profiles`` are given, so does a profile that
    isn't there, unless the door is IGNORE or NEEDS_CLASSIFICATION.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c)).otherwise(F.raise_error(F.lit(f"{c} must not be blank")))
    wanted = latest(requests, CAMERA, "at_ms").withColumn("logical_door", logical_door(F.col("logical_door"), DOOR_NAMES)).withColumns({c: filled(c) for c in CAMERA})
    if profiles is not None:
        known = profiles.select(F.col("id").alias("profile_id"), F.lit(True).alias("_known"))
        missing = F.col("profile_id").isNotNull() & F.col("_known").isNull() & ~F.col("logical_door").isin("IGNORE", "NEEDS_CLASSIFICATION")
        checked = F.when(missing, F.raise_error(F.lit("Door zone profile not found"))).otherwise(F.col("profile_id"))
        wanted = wanted.join(known, "profile_id", "left").withColumn("profile_id", checked).drop("_known")
    touched = wanted.select(*CAMERA, F.col("at_ms").alias("_at"))
    old = bindings.join(touched, CAMERA, "left")
    closes = F.col("active") & F.col("_at").isNotNull()
    old = old.withColumn("updated_ms", F.when(closes, F.col("_at")).otherwise(F.col("updated_ms"))).withColumn("active", F.col("active") & ~closes).select(*bindings.columns)
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    given = {"confirmed_by": clean, "preview_path": clean, "preview_frame": F.col}
    values = {"id": new_id(*CAMERA, F.col("at_ms").cast("string")), "active": F.lit(True), **{c: F.col("at_ms") for c in ("updated_ms", "confirmed_ms", "created_ms")}}
    values |= {c: f(c) for c, f in given.items() if c in wanted.columns} | {c: F.col(c) for c in (*CAMERA, "logical_door", "profile_id")}
    new = wanted.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in bindings.schema])
    return old.unionByName(new)


def deactivate(bindings: DataFrame, ident: int, at_ms: int) -> DataFrame:
    """Bindings with one of them closed; an id that isn't there raises NoSuchBinding."""
    if not bindings.where(F.col("id") == ident).limit(1).count():
        raise NoSuchBinding(ident)
    hit = F.col("id") == ident
    return bindings.withColumn("updated_ms", F.when(hit, F.lit(at_ms)).otherwise(F.col("updated_ms"))).withColumn("active", F.col("active") & ~hit)


#: Doors that a person may assign.
ASSIGNABLE = ("FRONT", "REAR", "CUSTOM", "IGNORE")


def pending_channels(bindings: DataFrame, samples: DataFrame, recorder: str | None = None) -> DataFrame:
    """Active cameras that wait for a door, newest first, with their newest sample file (samples: recorder_id, camera_code, path, modified_ms)."""
    rows = bindings.where(F.col("active") & (F.col("logical_door") == "NEEDS_CLASSIFICATION"))
    if recorder is not None and recorder.strip():
        rows = rows.where(F.col("recorder_id") == recorder.strip())
    newest = samples.groupBy(*CAMERA).agg(F.max_by("path", F.struct("modified_ms", "path")).alias("sample_path"))
    rows = rows.join(newest, CAMERA, "left").withColumn("preview_available", F.col("sample_path").isNotNull())
    return rows.orderBy(F.col("updated_ms").desc(), *CAMERA)


def assign(bindings: DataFrame, requests: DataFrame, samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bindings after doors were assigned (recorder_id, camera_code, logical_door, profile_id, at_ms, optionally frame_index).

    A door outside ASSIGNABLE raises an error; IGNORE drops the profile. The preview is the newest sample, else that of
    the binding before, as is its frame where none is asked for.
    """
    door = F.upper(F.trim("logical_door"))
    checked = F.when(door.isin(*ASSIGNABLE), door).otherwise(F.raise_error(F.lit("logicalDoor must be one of: " + ", ".join(ASSIGNABLE))))
    rows = requests.withColumn("logical_door", checked).withColumn("profile_id", F.when(F.col("logical_door") != "IGNORE", F.col("profile_id")))
    if "preview_path" in bindings.columns:
        newest = samples.groupBy(*CAMERA).agg(F.max_by("path", F.struct("modified_ms", "path")).alias("_sample"))
        before = bindings.where("active").select(*CAMERA, F.col("preview_path").alias("_path"), F.col("preview_frame").alias("_frame"))
        rows = rows.join(newest, CAMERA, "left").join(before, CAMERA, "left")
        frame = F.coalesce("frame_index", "_frame", F.lit(0)) if "frame_index" in requests.columns else F.coalesce("_frame", F.lit(0))
        rows = rows.withColumn("preview_path", F.coalesce("_sample", "_path")).withColumn("preview_frame", frame).drop("_sample", "_path", "_frame")
    return bind(bindings, rows, profiles)


def register_previews(bindings: DataFrame, previews: DataFrame) -> DataFrame:
    """Cameras seen in previews (recorder_id, camera_code, at_ms) without an active binding enter as unclassified; known ones get the time."""
    fresh = previews.join(bindings.where("active").select(*CAMERA), CAMERA, "left_anti")
    asked = fresh.select(*CAMERA, F.lit("NEEDS_CLASSIFICATION").alias("logical_door"), F.lit(None).cast("bigint").alias("profile_id"), "at_ms")
    seen = previews.groupBy(*CAMERA).agg(F.max("at_ms").alias("_seen"))
    known = bindings.join(seen, CAMERA, "left").withColumn("updated_ms", F.when(F.col("active"), F.greatest("updated_ms", "_seen")).otherwise(F.col("updated_ms"))).select(*bindings.columns)
    return bind(known, asked)


class NameTaken(ValueError):
    """Another profile has this name, case aside."""


class NoSuchProfile(KeyError):
    """There is no profile of this id."""


def put_profile(profiles: DataFrame, row: dict, ident: int | None = None) -> DataFrame:
    """Profiles with one inserted (no id given) or replaced."""
    name = row["name"].strip()
    clash = profiles.where((F.lower("name") == name.lower()) & (F.lit(ident is None) | (F.col("id") != F.lit(ident or -1))))
    if clash.limit(1).count():
        raise NameTaken(name)
    if ident is None:
        ident = (profiles.agg(F.max("id")).first()[0] or 0) + 1
    elif not profiles.where(F.col("id") == ident).limit(1).count():
        raise NoSuchProfile(ident)
    new = profiles.sparkSession.createDataFrame([{**{c: None for c in profiles.columns}, **row, "name": name, "id": ident}], profiles.schema)
    return profiles.where(F.col("id") != ident).unionByName(new)


def drop_profile(profiles: DataFrame, ident: int) -> DataFrame:
    if not profiles.where(F.col("id") == ident).limit(1).count():
        raise NoSuchProfile(ident)
    return profiles.where(F.col("id") != ident)


