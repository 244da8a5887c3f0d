"""Sinks: upserted results, per-key overwrites, and archiving of analysed files."""

from __future__ import annotations

import logging
import os
import shutil

from pyspark.sql import DataFrame, SparkSession

from ..lineage import file_system
from .table_log import TableLog

log = logging.getLogger(__name__)


def save_results(new: DataFrame, path: str, key: str = "session_id", by: str = "finished_ms", enabled: bool = True) -> bool:
    """Upserts into a stored table by key, on any file system that Spark writes to. A failure is logged, not raised: counting goes on, and the table is as it was."""
    if not enabled:
        return False
    try:
        TableLog(new.sparkSession, path).upsert(new, key, by)
    except Exception:  # noqa: BLE001
        log.exception("results were not saved")
        return False
    return True


def load_results(spark, path: str) -> DataFrame:
    found = TableLog(spark, path).load()
    if found is None:
        raise ValueError(f"{path} holds no results")
    return found


def batch_upsert(path: str, key: str = "session_id", by: str = "finished_ms", name: str | None = None):
    """For ``writeStream.foreachBatch``. A failure is raised, so that the stream doesn't go on without the batch; a batch that comes again is applied once.

    Batches are known by their number and ``name``, or else the query's id, which lasts as long as its checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = name or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        TableLog(spark, path).upsert(batch, key, by, (query, number))

    return run


def _archived(spark: SparkSession, path: str, status: str, home: str, processed: str, keep: bool) -> str | None:
    """``after_analysis`` on the file systems that the paths name: a rename, or a copy where ``processed`` is on another one."""
    named, system = file_system(spark, path)
    file, top = system.makeQualified(named).toString(), system.makeQualified(file_system(spark, home)[0]).toString()
    if not file.startswith(top.rstrip("/") + "/") or not system.exists(named) or not system.getFileStatus(named).isFile():
        return None
    if not keep:
        system.delete(named, False)
        return None
    folder, other = file_system(spark, f"{processed.rstrip('/')}/{status.lower()}")
    target, _ = file_system(spark, f"{folder.toString()}/{named.getName()}")
    if system.makeQualified(named).equals(other.makeQualified(target)):
        return target.toString()
    other.mkdirs(folder)
    if not system.getUri().equals(other.getUri()):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, named, other, target, True, True, spark._jsc.hadoopConfiguration())
        return target.toString()
    if other.exists(target):
        other.delete(target, False)
    if not system.rename(named, target):
        raise OSError(f"{path} could not be moved to {target.toString()}")
    return target.toString()


def after_analysis(path: str, status: str, home: str, processed: str, keep: bool = True, spark: SparkSession | None = None) -> str | None:
    """Moves a file under ``home`` to ``<processed>/<status>/<its name>``, or deletes it; other files stay. Returns the new place.

    Without ``spark`` these are paths of the local disk, and links are followed before they are compared with ``home``. With it they may be on
    any file system that Spark knows; dots in a path are resolved, links are not followed.
    """
    if spark is not None:
        return _archived(spark, path, status, home, processed, keep)
    real, top = os.path.realpath(path), os.path.realpath(home)
    if not real.startswith(top + os.sep) or not os.path.isfile(real):
        return None
    if not keep:
        os.unlink(real)
        return None
    target = os.path.join(os.path.realpath(processed), status.lower(), os.path.basename(real))
    os.makedirs(os.path.dirname(target), exist_ok=True)
    shutil.move(real, target)
    return target


def park_unclassified(path: str, home: str, processed: str, keep: bool = True, spark: SparkSession | None = None) -> str | None:
    """A clip whose camera has no door waits in ``<processed>/needs-classification``."""
    return after_analysis(path, "needs-classification", home, processed, keep, spark)


def replace_atomically(data: bytes, path: str) -> None:
    """The latest preview of a camera: readers see the old file or the new one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)
