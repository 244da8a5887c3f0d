"""What the corpus operators share: reading tables, cutting lineage, giving memory back, temporary column names."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..lineage import cut, shared_dir  # noqa: F401

#: ASCII white space and words, the same characters in Java, Python and RE2.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


#: Bytes of an Arrow batch: what a task holds of a table of texts on either side, however long the texts are.
BATCH_BYTES = 1 << 20

_caches: list[dict] = []


def cache() -> dict:
    """A dictionary of what is costly to make, such as vocabularies; it is kept between tasks until another operator runs in the worker."""
    _caches.append({})
    return _caches[-1]


def tidy(keep: dict | None = None) -> None:
    """Gives memory that a task of Python held back to the system; workers live on and run other tasks. Caches but ``keep`` are emptied."""
    for held in _caches:
        if held is not keep:
            held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that don't clash with those of ``df`` (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(df: DataFrame, struct, fields: list[str]) -> DataFrame:
    """``df`` with the fields of the struct column ``struct`` as columns; they replace columns of the same name."""
    (tmp,) = fresh(df, "_out")
    kept = [c for c in df.columns if c.lower() not in {f.lower() for f in fields}]
    wide = df.withColumn(tmp, struct)
    return wide.select(*[wide[f"`{c}`"] for c in kept], *[wide[f"{tmp}.{f}"].alias(f) for f in fields])
