"""Session set-up: a local session for tests and benches, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session on ``local[cpus]`` in UTC; ``conf`` keys use double underscores for dots."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("trackweave")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions or cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="trackweave-"), "trackweave.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
