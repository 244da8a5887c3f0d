"""A versioned table of rows by key, for upserts that can be repeated: data folders, and a log whose versions are taken by compare and swap.

A version is a small file that names, for each part of the table (by the hash of the key), the folder that holds it, and the last batch of every
stream that is in it. A write merges its rows into the parts that they touch, in a new folder, then puts the next version beside the others. If another writer was first, it begins again from
that version. What was written without becoming a version is never read, so a write that is killed at any point leaves the table as it was, and a batch that comes
again is known by its stream and number and isn't applied twice. Readers see whole versions.

The swap is a rename that doesn't replace, which HDFS decides atomically; on a local disk and on stores without such a rename, only one process may write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import delete, file_system
from ..operators.results import upsert

#: Parts of a table; an upsert rewrites those that it touches.
BUCKETS = 64
ATTEMPTS = 10


class Conflict(RuntimeError):
    """Other writers took every version that this one tried for."""


class TableLog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def version(self) -> tuple[int, dict]:
        """The latest version, its parts' folders and the streams' last batches; version 0 is an empty table."""
        folder, system = file_system(self.spark, f"{self.path}/log")
        names = sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and n[0] != "."]
        if not names:
            return 0, {"parts": {}, "applied": {}, "schema": None, "buckets": self.buckets}
        (text,) = self.spark.read.text(f"{self.path}/log/{names[-1]}", wholetext=True).first()
        return int(names[-1].split(".")[0]), json.loads(text)

    def _swap(self, version: int, state: dict) -> bool:
        """Puts a version into the log unless it is there already."""
        target, system = file_system(self.spark, self._log(version))
        draft, _ = file_system(self.spark, f"{self.path}/log/.{uuid.uuid4().hex}")
        out = system.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not system.exists(target) and system.rename(draft, target):
            return True
        system.delete(draft, False)
        return False

    def _rows(self, state: dict, parts: list[str] | None = None) -> DataFrame | None:
        wanted = [k for k in (state["parts"] if parts is None else parts) if k in state["parts"]]
        if state["schema"] is None:
            return None
        kind = json.loads(state["schema"])
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(kind)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{state['parts'][k]}/bucket={k}" for k in wanted])

    def load(self) -> DataFrame | None:
        """The rows of the latest version; None before the first."""
        return self._rows(self.version()[1])

    def upsert(self, new: DataFrame, key: str, by: str, batch: tuple[str, int] | None = None) -> int:
        """Merges ``new`` by key (new rows replace old ones; of several the latest by ``by`` counts) and returns the version that holds it. ``batch``, a stream's name and a batch's number, is applied once."""
        for _ in range(ATTEMPTS):
            version, state = self.version()
            if batch is not None and state["applied"].get(batch[0], -1) >= batch[1]:
                return version
            if state["schema"] is not None and {f["name"] for f in json.loads(state["schema"])["fields"]} != set(new.columns):
                raise ValueError(f"{self.path} has other columns")
            rows = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int"))
            touched = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]  # of BUCKETS at most
            before = self._rows(state, touched)
            merged = upsert(new.limit(0) if before is None else before.select(*new.columns), new, key, by)
            folder = uuid.uuid4().hex
            merged = merged.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int"))
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            applied = state["applied"] | ({batch[0]: batch[1]} if batch is not None else {})
            schema = state["schema"] or json.dumps(new.schema.jsonValue())
            if self._swap(version + 1, {"parts": state["parts"] | dict.fromkeys(touched, folder), "applied": applied, "schema": schema, "buckets": state["buckets"]}):
                return version + 1
            delete(self.spark, f"{self.path}/data/{folder}")
        raise Conflict(f"{self.path}: {ATTEMPTS} versions were taken by others")

    def vacuum(self) -> int:
        """Drops folders and versions that the latest version doesn't need: only while nobody reads older ones or writes. Returns the number of folders."""
        version, state = self.version()
        dropped = 0
        for name, needed in (("data", set(state["parts"].values())), ("log", {f"{version:020d}.json"})):
            folder, system = file_system(self.spark, f"{self.path}/{name}")
            for s in system.listStatus(folder) if system.exists(folder) else []:
                if s.getPath().getName() not in needed:
                    system.delete(s.getPath(), True)
                    dropped += name == "data"
        return dropped
