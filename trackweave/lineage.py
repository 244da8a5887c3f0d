"""Cutting lineage with tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "trackweave-"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, and only on a
    local master (tests), a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix=_PREFIX)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str | int) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that its lineage ends there.

    A lost executor then costs tasks of later stages only, never a recomputation of this one. ``clear`` drops the tables.
    ``by`` names columns whose values become folders, so that filters on them read no other; ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_PREFIX}{name}-{uuid.uuid4().hex}"
    _written.append(path)
    out = df.write.options(compression="zstd", **options)
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Drops all tables that ``cut`` wrote in this process, once the results that read them are stored. Returns their number."""
    n = 0
    while _written:
        n += delete(spark, _written.pop())
    return n


def file_system(spark: SparkSession, path: str):
    """A path and the file system that it names, as Hadoop objects."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder on whatever file system the path names."""
    where, system = file_system(spark, path)
    return bool(system.exists(where))


def delete(spark: SparkSession, path: str) -> bool:
    where, system = file_system(spark, path)
    return bool(system.delete(where, True))
