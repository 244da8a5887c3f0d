"""File sources: recursive listings, and a stream over a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

#: How often a landing folder is looked at.
EVERY = "15 seconds"


def listing(spark: SparkSession, *roots: str, with_content: bool = False) -> DataFrame:
    """path, size, modified_ms of all files under the roots; contents are read only if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    path = F.regexp_replace("path", "^file:/*", "/")
    columns = [path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms")]
    return rows.select(*columns, *([F.col("content")] if with_content else []))


def landing_stream(spark: SparkSession, root: str, per_trigger: int = 10, archive: str | None = None) -> DataFrame:
    """New clips under ``<digits>/<yyyy-MM-dd>/`` of a landing folder, never those in a processed folder.

    With ``archive``, a folder outside of ``root`` on the same file system, files move there under their whole path once their batch is done.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger)
    rows = (rows.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else rows).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    fine = P.in_device_layout(path, root) & P.extension(path).isin(*P.INGEST_EXTENSIONS)
    return rows.where(fine).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), "modificationTime", F.sha2("content", 256).alias("sha256"))


def completed_uploads(events: DataFrame, home: str) -> DataFrame:
    """Uploads (argument, working_dir) that ended, as paths under ``home``; blank ones and those that escape it are left out.

    A relative argument is taken from the client's working folder, an absolute one from ``home``; quotes and backslashes are normalised.
    """
    asked = F.regexp_replace(F.regexp_replace(F.trim("argument"), '^"+|"+$', ""), r"\\", "/")
    cwd = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("working_dir", F.lit(""))), r"\\", "/"), "^/+|/+$", "")
    relative = F.when(asked.startswith("/"), F.regexp_replace(asked, "^/", "")).otherwise(F.concat_ws("/", F.nullif(cwd, F.lit("")), asked))
    rows = events.where(F.trim(F.coalesce("argument", F.lit(""))) != "").withColumn("path", F.concat(F.lit(home.rstrip("/") + "/"), relative))
    return rows.where(P.inside_home(F.col("path"), home))


def start(stream: DataFrame, sink, checkpoint: str, every: str = EVERY):
    """Runs a stream into ``sink`` (batch, number), looking for new files at a fixed interval."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
