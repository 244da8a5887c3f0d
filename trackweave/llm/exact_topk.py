"""Exact top-k search by inner product: global score histograms are refined until each kth score is known.

Every query is scored against every vector, in blocks. Vectors are packed into blocks and
dealt to salted slices; every block of queries goes to every slice, so that no key holds more
than one slice. In each round a task adds its scores into a histogram per query over that query's
current score range, and sends only the bins that can still hold the kth score: those from its own kth score
up, plus one count for what lies above the range. The sums over all tasks narrow the range to one
bin, until it is a single score. A last pass keeps scores above the kth, and of those equal to it
each task's smallest ids; ties go to smaller ids.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part.
Vectors of different lengths never meet: queries are scored against vectors of their own length only.
Empty vectors are vectors of length 0 and score 0. Components that exceed 64 bits count as the nearest 64-bit integer,
scores beyond 62 bits as the nearest one within. An empty table gives an empty result. Repeated ids are separate candidates, apart from a query's own id.
Repeated queries are ranked row by row: each has its own k rows in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a block of data and of queries; blocks of data in a slice; bins of a round; factor of the integers.
DATA_BLOCK, QUERY_BLOCK, SLICE, BINS, SCALE = 2048, 512, 4, 256, 64
#: Scores from -MOST to MOST - 1 are exact; what lies beyond counts as the nearest of them.
MOST = 1 << 62


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length: dim, n, ids (int64 bytes), data (float64 bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "data": [np.stack(data).astype("<i8").tobytes()]})

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.asarray(x.values)
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(pack, "dim int, n int, ids binary, data binary")


def _whole(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(row: dict, kind: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{kind}ids"], "<i8")
    data = row[f"{kind}data"]
    return ids, (np.frombuffer(data, "<i8") if data else np.zeros(0, "<i8")).reshape(len(ids), row["dim"])


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where that is exact, by unbounded integers where 64 bits could overflow."""
    bound = float(np.abs(q.astype("f8")).max(initial=0)) * float(np.abs(d.astype("f8")).max(initial=0)) * q.shape[1]
    if bound < 2**52:
        return (q.astype("f8") @ d.astype("f8").T).astype("i8")
    if bound < MOST:
        return q @ d.T
    return np.clip(q.astype(object) @ d.astype(object).T, -MOST, MOST - 1).astype("i8")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Each query's k highest scores against all vectors but its own: query_id, rank, vec_id, score."""
    # Blocks are read in every round. Slices are numbered after packing, so that they are the same each time.
    data = cut(_pack(_whole(vectors, id_col, vector, scale), DATA_BLOCK), "topk-data")
    asked = cut(_pack(_whole(queries, id_col, vector, scale), QUERY_BLOCK).withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    n_blocks = data.count()
    slices = max(1, -(-n_blocks // SLICE))
    # Spark's estimate of blocks is that of their compressed files and knows nothing of the copies for each slice, so joins are never left to broadcast them.
    dealt = data.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices).cast("long"))).select("dim", "slice", "ids", "data")
    each_slice = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")

    def met_with(ranges: DataFrame) -> DataFrame:
        """Every block of queries, with its ranges, beside every block of data; of a slice only the data are held."""
        wanted = asked.join(ranges.select("block", "lows").hint("merge"), "block").select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "lows", each_slice)
        return wanted.join(dealt.hint("merge"), ["dim", "slice"]).select("dim", "block", "ids", "data", "q_ids", "q_data", "lows")

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in rows:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def own_out(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, d = _matrix(row)
        q_ids, q = _matrix(row, "q_")
        return q_ids, ids, _scores(q, d)

    # Bounds from norms: |score| <= |q| * max |d| <= half, a power of BINS that all queries start from.
    def norms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = 0.0
        for row in each(rows):
            best = max(best, float(np.sqrt((_matrix(row)[1].astype("f8") ** 2).sum(1)).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"norm": [best]})

    longest = [(x.select("dim", "n", "ids", "data").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0) for x in (data, asked)]
    half = 1
    while half < MOST and half <= longest[0] * longest[1] + 1:
        half *= 2
    def histograms(step: int, bins: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in each(rows):
                q_ids, ids, s = own_out(row)
                at = (s - np.array(row["lows"], "i8")[:, None]) // step
                at[at >= bins] = bins  # above the range: counted together
                at[(at < 0) | (ids[None, :] == q_ids[:, None])] = -1
                flat = (at + 1) + (np.arange(len(q_ids)) * (bins + 2))[:, None]
                counts = np.bincount(flat.ravel(), minlength=len(q_ids) * (bins + 2)).reshape(len(q_ids), bins + 2)[:, 1:]
                higher = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # a bin with k scores above it in this task alone is out
                r, b = np.nonzero((counts > 0) & (higher < k))
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(r), row["block"]), pa.int64()), "q": pa.array(r, pa.int32()), "bin": pa.array(b, pa.int32()), "n": pa.array(counts[r, b], pa.int64())})

        return run

    width = 2 * half
    state = asked.select("block", "n", F.array_repeat(F.lit(-half).cast("long"), F.col("n")).alias("lows"))
    while width > 1:
        step = max(1, width // BINS)
        counted = met_with(state).mapInArrow(histograms(step, width // step), "block long, q int, bin int, n long").groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("block", "q").orderBy(F.col("bin").desc())
        counted = counted.withColumn("up_to", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        found = counted.where((F.col("up_to") >= k) & (F.col("up_to") - F.col("n") < k)).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("q", "bin"))).alias("bins"))
        # A query with fewer than k scores finds no bin and keeps the lowest range, so that all its scores stay.
        moved = F.zip_with("lows", F.sequence(F.lit(0), F.col("n") - 1), lambda low, i: low + F.coalesce(F.try_element_at("bins", i), F.lit(0)).cast("long") * step)
        state = cut(state.join(found, "block", "left").select("block", "n", moved.alias("lows")), "topk-ranges")
        width = step

    def last(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(rows):
            q_ids, ids, s = own_out(row)
            low = np.array(row["lows"], "i8")[:, None]
            other = ids[None, :] != q_ids[:, None]
            above, tied = (s > low) & other, (s == low) & other
            order = np.argsort(ids, kind="stable")
            small = np.zeros_like(tied)
            small[:, order] = tied[:, order] & (tied[:, order].cumsum(1) <= k)
            r, c = np.nonzero(above | small)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(r), row["block"]), pa.int64()), "q": pa.array(r, pa.int32()), "query_id": pa.array(q_ids[r]), "vec_id": pa.array(ids[c]), "score": pa.array(s[r, c])})

    kept = met_with(state).mapInArrow(last, "block long, q int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
