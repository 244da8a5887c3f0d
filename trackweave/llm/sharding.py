"""Sharding by a uniform shuffle: exact counts from partitions to shards, a permutation within each partition, one exchange, and a permutation within each shard.

The rows are written once; each file of that table is a partition, and a row is known by its file and place, so every
later step is a function of the two that a repeated task computes again. How many rows of each partition go to each
shard is a row of a random matrix whose margins are fixed: the files' counts on one side and shard sizes at most one apart on
the other. Under a uniform shuffle that matrix is multivariate hypergeometric. It is drawn by halving the list of
files: a half takes its shares of what its parent holds of each shard. Draws are seeded by the halves' borders, so a task
walks to its own file alone and all tasks agree. A seeded permutation of a file's rows, cut by these counts, names
each row's shard. After the exchange, rows of a shard are ordered by random numbers: first by ranges of them that hold about PART rows,
counted beforehand, and then within a range, so no task sorts a whole shard.

The law is `rows`. Nulls, empty and long texts, ties and repeated rows are rows like any others: no column decides where a row goes, and copies are
spread like the rest. An empty table gives an empty one. Columns named like those that are added are replaced. The same table in the
same partitions with the same seed gives the same shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, tidy

#: Most rows of a partition, whose permutation a task holds, and about how many rows of a shard are ordered in one go.
PARTITION_ROWS, PART = 1 << 20, 1 << 16
SHARDS, SEED = 24, 7
#: Up to here the library draws; beyond, this many standard deviations around the mean are searched.
LIBRARY_MOST, WIDTH = 900_000_000, 40


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many of ``sample`` balls, drawn without putting back, are among the ``good``."""
    if good + bad <= LIBRARY_MOST:
        return int(rng.hypergeometric(good, bad, sample)) if good and sample else 0
    low, high = max(0, sample - bad), min(sample, good)
    total = good + bad
    mean = sample / total * good
    spread = (max(mean * (bad / total) * ((total - sample) / max(total - 1, 1)), 1.0)) ** 0.5
    low, high = max(low, int(mean - WIDTH * spread) - WIDTH), min(high, int(mean + WIDTH * spread) + WIDTH)
    at = np.arange(low, high, dtype=np.float64)
    # Ratios of neighbouring probabilities, added up as logarithms
    steps = np.log(good - at) + np.log(sample - at) - np.log(at + 1) - np.log(bad - sample + at + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def share(colours: np.ndarray, sample: int, rng: np.random.Generator) -> np.ndarray:
    """The counts by colour of ``sample`` balls drawn without putting back."""
    left = int(colours.sum())
    if left <= LIBRARY_MOST:
        return rng.multivariate_hypergeometric(colours, sample, method="marginals")
    out = np.zeros_like(colours)
    for k, n in enumerate(colours.tolist()):
        left -= n
        out[k] = hypergeometric(n, left, sample, rng)
        sample -= int(out[k])
    return out


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


class Matrix:
    """The communication matrix, a row at a time: ``counts[p]`` rows of partition p go to the shards as ``row(p)`` says."""

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.before = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        self.shards, self.seed = shards, seed

    def row(self, p: int) -> np.ndarray:
        low, high = 0, len(self.before) - 1
        colours = shard_sizes(int(self.before[-1]), self.shards)
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng([self.seed, 0, low, high])
            first = share(colours, int(self.before[middle] - self.before[low]), rng)
            low, high, colours = (low, middle, first) if p < middle else (middle, high, colours - first)
        return colours


def _dealt(held: DataFrame, name: str, row: str, matrix: Matrix, files: dict[str, int], parts: int, shard: str, part: str, place: str) -> DataFrame:
    """``held`` with the shard of each row, a random number of 63 bits and the number's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shards, numbers = None, None, None
        for batch in batches:
            names, rows = batch.column(name).dictionary_encode(), batch.column(row).to_numpy(zero_copy_only=False)
            where = names.indices.to_numpy(zero_copy_only=False)
            to, number = np.empty(len(rows), np.int32), np.empty(len(rows), np.int64)
            for k, file in enumerate(names.dictionary.to_pylist()):
                if file != last:
                    p = files[file]
                    counts = matrix.row(p)
                    rng = np.random.default_rng([matrix.seed, 1, p])
                    shards = rng.permutation(np.repeat(np.arange(matrix.shards, dtype=np.int32), counts))
                    numbers, last = rng.integers(0, 1 << 63, len(shards), np.int64), file
                mine = where == k
                to[mine], number[mine] = shards[rows[mine]], numbers[rows[mine]]
            arrays = [*batch.columns, pa.array(to), pa.array((number >> 32) * parts >> 31, pa.int64()), pa.array(number)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, shard, part, place])
        tidy()

    kind = T.StructType([*held.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(part, T.LongType()), T.StructField(place, T.LongType())])
    return held.mapInArrow(run, kind)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, partition_rows: int = PARTITION_ROWS, part_rows: int = PART) -> DataFrame:
    """``docs`` with law ('rows'), shard, slot (from 0 in each shard, without gaps) and grown_shard (null under this law)."""
    added = ["law", "shard", "slot", "grown_shard"]
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in added])
    name, row, part, place, first, n = fresh(docs, "_file", "_row", "_part", "_place", "_first", "_n")
    kept = cut(docs, "shard-rows", maxRecordsPerFile=partition_rows)
    meta = kept.metadataColumn("_metadata")
    held = kept.select("*", meta["file_name"].alias(name), meta["row_index"].alias(row))
    found = sorted((r[0], r[1]) for r in held.groupBy(name).count().collect())  # a number for each file
    matrix = Matrix([c for _, c in found], shards, seed)
    parts = max(1, -(-int(matrix.before[-1]) // (shards * part_rows)))
    dealt = _dealt(held, name, row, matrix, {f: p for p, (f, _) in enumerate(found)}, parts, "shard", part, place)
    counts = dealt.groupBy("shard", part).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy("shard", part).orderBy(place, name, row)
    placed = dealt.join(starts, ["shard", part])
    slot: Column = (F.col(first) + F.row_number().over(inside) - 1).cast("long")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str, rows_a_file: int = PARTITION_ROWS) -> None:
    """Writes ``sharded`` by shard, each shard's files in order of slots: no file holds more than ``rows_a_file`` rows."""
    (file,) = fresh(sharded, "_file")
    cutting = sharded.withColumn(file, F.floor(F.col("slot") / rows_a_file))
    cutting.repartition("shard", file).sortWithinPartitions("shard", "slot").drop(file).write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def sizes(text: Column) -> tuple[Column, Column]:
    """A document's size (UTF-8 bytes and 8) and its text's CRC-32; a null text counts as an empty one."""
    body = F.coalesce(text, F.lit(""))
    return (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
