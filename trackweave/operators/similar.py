"""The most similar vector of a pool, exact, by bounds: vectors stand in blocks, and pivots tell which blocks can't hold a better one.

A few vectors of the pool are pivots. By the triangle inequality two vectors are at least as far apart as their distances to a pivot
differ, and their dot product is half of what their squared lengths exceed their squared distance by; so the ranges of two blocks'
distances to the pivots bound all dot products between them. Only bounds are joined by key; matrices follow the pairs that are left:

1. each block of probes is scored against the pool block of its key that lies nearest by its distances to the pivots;
2. then against those whose bound reaches the least that its probes have found so far, and there for the probes that it can still help.

A matrix product finds what may be the best within rounding; those are summed component by component, in the order of a fold, so that equal vectors tie exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut

#: Rows of a block at most, and vectors that are pivots.
BLOCK = 512
PIVOTS = 16
#: Rounding, as a share of the squared lengths, that bounds and matrix products may be wrong by.
SLACK = 1e-9

_BLOCK = "_ids array<bigint>, _vectors binary, _far binary, _norm double, _low array<double>, _high array<double>"
_SCORED = "_a bigint, _n bigint, _places array<int>, _found array<double>, _winners array<bigint>, _pairs bigint"


def _fit(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = batch.column("_v")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows x pivots; pivots of another length are cut or filled with zeros, which leaves them points that all rows of a block share."""
    dim = rows.shape[1]
    cut_to = np.zeros((len(pivots), dim))
    cut_to[:, : pivots.shape[1]] = pivots[:, :dim]
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in cut_to], axis=1)


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose vector has components, none of them null or non-finite, and their number as ``_dim``."""
    vectors = batch.column("_v")
    dims = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), dtype=np.int32)
    values = np.asarray(pc.fill_null(vectors.flatten(), float("nan")), dtype=np.float64)
    fine = dims > 0
    fine[np.asarray(pc.list_parent_indices(vectors))[~np.isfinite(values)]] = False
    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims)], names=[*batch.schema.names, "_dim"])
    return batch if fine.all() else batch.filter(pa.array(fine))


def _placed(pivots: np.ndarray):
    """Appends the length, the nearest pivot and its distance, by which vectors are sorted into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_whole, batches):
            dims = np.asarray(batch.column("_dim"))
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                d = _distances(_fit(batch.take(pa.array(at)), int(dim)), pivots)
                cell[at] = d.argmin(axis=1)
                far[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "_cell", "_near"])

    return run


def _packed(keys: list[str], pivots: np.ndarray, most: int, side: str):
    """Rows in order of their keys to blocks of at most ``most`` rows of one key."""

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        dim = rows.column("_dim")[0].as_py()
        v = _fit(rows, dim)
        far = _distances(v, pivots)
        head = rows.slice(0, 1)
        fields = [head.column(k).combine_chunks() for k in [*keys, "_dim"]]
        values = [
            pa.array([number], pa.int64()), pa.array([rows.column("_id").to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([far.tobytes()], pa.binary()),
            pa.array([float(np.sqrt((v * v).sum(axis=1).max()))]), pa.array([far.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([far.max(axis=0).tolist()], pa.list_(pa.float64())),
        ]
        names = [*keys, "_dim", side, "_ids", "_vectors", "_far", "_norm", "_low", "_high"]
        return pa.RecordBatch.from_arrays([*fields, *values], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for k in [*keys, "_dim"]:
                c = rows.column(k)
                new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(rows) - 1)).combine_chunks().to_numpy(zero_copy_only=False), bool)
            starts = [0, *np.flatnonzero(new).tolist(), len(rows)]
            cuts = sorted({p for a, b in zip(starts, starts[1:], strict=False) for p in range(a, b, most)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield block(rows.slice(a, b - a), number)
                number += 1
            held = rows.slice(cuts[-1])
        if held is not None:
            yield block(held, number)

    return run


def _blocks(rows: DataFrame, keys: list[str], pivots: np.ndarray, most: int, side: str) -> DataFrame:
    """Vectors (keys, _id, _v) as a written table of blocks; hot keys are ranges of rows like all others, so no task holds a key."""
    spark = rows.sparkSession
    kinds = [rows.schema[k] for k in keys] + [T.StructField("_dim", T.IntegerType())]
    order = [*keys, "_dim", "_cell", "_near", "_id"]
    wide = T.StructType([*rows.schema.fields, T.StructField("_dim", T.IntegerType()), T.StructField("_cell", T.IntegerType()), T.StructField("_near", T.DoubleType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.mapInArrow(_placed(pivots), wide), "placed")  # the ranges below are found by a pass of their own
    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*kinds, T.StructField(side, T.LongType()), *T.StructType.fromDDL(_BLOCK).fields])
    return cut(sorted_rows.mapInArrow(_packed(keys, pivots, most, side), schema), f"vectors{side}")


def _usable(rows: DataFrame, keys: list[str], number: str, vector: str) -> DataFrame:
    return rows.select(*keys, F.col(number).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where(F.col(number).isNotNull())


def _bound(low_a: Column, high_a: Column, low_b: Column, high_b: Column, norm_a: Column, norm_b: Column) -> Column:
    """No dot product between two blocks is above this."""
    apart = lambda low, high: F.array_max(F.zip_with(low, high, lambda x, y: x - y))
    gap = F.greatest(F.lit(0.0), apart(low_a, high_b), apart(low_b, high_a))
    squares = norm_a * norm_a + norm_b * norm_b
    return F.least(norm_a * norm_b, (squares - gap * gap) / 2) + squares * SLACK


def _score(threshold: float):
    """Rows of two blocks each, and what the probes have reached before, to each probe's best of the block where it reaches as much."""

    def best(row: dict, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        dim, mine, theirs = row["_dim"], np.array(row["_ids"]), np.array(row["_pool_ids"])
        q, x = np.frombuffer(row["_vectors"]).reshape(-1, dim), np.frombuffer(row["_pool_vectors"]).reshape(-1, dim)
        far = np.frombuffer(row["_far"]).reshape(len(q), -1)
        gap = np.maximum(np.maximum(np.array(row["_pool_low"]) - far, far - np.array(row["_pool_high"])), 0).max(axis=1)
        squares = (q * q).sum(axis=1) + row["_pool_norm"] ** 2
        tolerance = squares * SLACK
        active = np.flatnonzero((squares - gap * gap) / 2 + tolerance >= reached)
        if not len(active):
            return active, np.zeros(0), active, 0
        s = q[active] @ x.T
        s[np.equal.outer(mine[active], theirs)] = -np.inf
        least = np.maximum(s.max(axis=1), reached[active]) - tolerance[active]
        i, j = np.nonzero(s >= least[:, None])
        exact = np.zeros(len(i))
        for k in range(dim):
            exact += q[active[i], k] * x[j, k]
        fine = (exact > threshold) & (exact >= reached[active[i]])
        i, j, exact = i[fine], j[fine], exact[fine]
        order = np.lexsort((theirs[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        return active[i[first]], exact[first], theirs[j[first]], s.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_a", pa.int64()), ("_n", pa.int64()), ("_places", pa.list_(pa.int32())), ("_found", pa.list_(pa.float64())), ("_winners", pa.list_(pa.int64())), ("_pairs", pa.int64())])
        block, reached = None, np.zeros(0)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["_a"] != block:  # a block's pairs come one after another, so what one gives bounds the next
                    block, reached = row["_a"], np.full(len(row["_ids"]), threshold) if row["_reached"] is None else np.array(row["_reached"])
                places, found, winners, pairs = best(row, reached)
                reached[places] = found
                values = [row["_a"], len(row["_ids"]), places.tolist(), found.tolist(), winners.tolist(), pairs]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

    return run


def _scored(pairs: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks (_a, _b, _reached) with their matrices, which meet in the join's tasks and go no further."""
    mine = a.select("_a", "_dim", "_ids", "_vectors", "_far")
    theirs = b.select("_b", *[F.col(c).alias(f"_pool{c}") for c in ("_ids", "_vectors", "_norm", "_low", "_high")])
    return pairs.join(theirs.hint("merge"), "_b").join(mine.hint("merge"), "_a").mapInArrow(_score(threshold), _SCORED)


def scores(probes: DataFrame, pool: DataFrame, keys: list[str], threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Blocks of probes, and for each pair of blocks that was scored the best of its probes and the number of dot products (``_pairs``), as written tables."""
    if threshold < 0:
        raise ValueError("a threshold of 0 or more is needed: vectors of different lengths have similarity 0")
    left, right = _usable(probes, keys, "probe_id", "probe_embedding"), _usable(pool, keys, "pool_id", "pool_embedding")
    for k in keys:
        left, right = left.where(F.col(k).isNotNull()), right.where(F.col(k).isNotNull())
    chosen = [r._v for r in right.select(F.xxhash64("_id").alias("_h"), "_id", "_v").orderBy("_h", "_id").limit(pivots).collect() if r._v]
    points = np.zeros((max(len(chosen), 1), max(map(len, chosen), default=1)))
    for k, v in enumerate(chosen):
        points[k, : len(v)] = np.nan_to_num(np.array(v, dtype=np.float64), posinf=0, neginf=0)
    a, b = _blocks(left, keys, points, block, "_a"), _blocks(right, keys, points, block, "_b")
    about = ["_norm", "_low", "_high"]
    theirs = b.select(*keys, "_dim", "_b", *[F.col(c).alias(f"_pool{c}") for c in about])
    upper = _bound(F.col("_low"), F.col("_high"), F.col("_pool_low"), F.col("_pool_high"), F.col("_norm"), F.col("_pool_norm"))
    middles = F.zip_with(F.zip_with("_low", "_high", lambda x, y: x + y), F.zip_with("_pool_low", "_pool_high", lambda x, y: x + y), lambda x, y: F.abs(x - y))
    away = F.aggregate(middles, F.lit(0.0), lambda s, x: s + x)
    met = a.select(*keys, "_dim", "_a", *about).join(theirs, [*keys, "_dim"]).select("_a", "_b", upper.alias("_upper"), away.alias("_away")).where(F.col("_upper") > threshold)
    met = cut(met, "pairs")
    first = met.groupBy("_a").agg(F.min_by("_b", F.struct("_away", "_b")).alias("_b"))
    before = cut(_scored(first.withColumn("_reached", F.lit(None).cast("array<double>")), a, b, threshold).join(first, "_a"), "scores")
    by_place = F.map_from_arrays("_places", "_found")
    every = F.transform(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), lambda k: F.coalesce(F.try_element_at(by_place, k), F.lit(float(threshold))))
    reached = before.select("_a", every.alias("_reached"))
    rest = met.join(first, ["_a", "_b"], "left_anti").join(reached, "_a").where(F.col("_upper") >= F.array_min("_reached"))
    after = cut(_scored(rest.select("_a", "_b", "_reached"), a, b, threshold), "scores")
    return a, before.drop("_b").unionByName(after)


def best_match(probes: DataFrame, pool: DataFrame, keys: list[str], threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Each probe's most similar pool row of its keys, if above the threshold (0 or more); ties go to the smaller pool id.

    Similarity is the dot product, the cosine of normalised vectors; 0 for different lengths. Rows with a null key or id, and vectors that are null, empty or hold
    null or non-finite components, take no part. A row isn't its own match (equal ids). Probes that repeat count as one.
    """
    a, found = scores(probes, pool, keys, threshold, block, pivots)
    kinds = {"probe_id": probes.schema["probe_id"].dataType, "pool_id": pool.schema["pool_id"].dataType}
    rows = found.select("_a", F.explode(F.arrays_zip("_places", "_found", "_winners")).alias("_r")).select("_a", "_r.*")
    rows = rows.groupBy("_a", "_places").agg(F.max(F.struct("_found", (-F.col("_winners")).alias("_minus"))).alias("_best"))
    ids = a.select(*keys, "_a", F.posexplode("_ids").alias("_places", "probe_id"))
    rows = ids.join(rows, ["_a", "_places"]).groupBy(*keys, "probe_id").agg(F.max("_best").alias("_best"))
    return rows.select(*keys, F.col("probe_id").cast(kinds["probe_id"]), (-F.col("_best._minus")).cast(kinds["pool_id"]).alias("pool_id"), F.col("_best._found").alias("similarity"))
