"""Sharding: exact sizes, gapless slots, nothing lost, uniform draws, equal reruns."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import sharding


def cases(spark, n, parts=5):
    return spark.range(n).select((F.col("id") % 7).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id") % 5)).alias("text"), F.col("id").alias("Slot"), F.col("id").alias("_file"), F.lit("m").alias("_metadata")).repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 23, 24, 1000])
def test_sizes_are_exact_and_slots_gapless(spark, n):
    docs = cases(spark, n)
    out = sharding.shard_rows(docs, 24, partition_rows=70, part_rows=9)
    assert out.columns == ["doc_id", "text", "_file", "_metadata", "law", "shard", "slot", "grown_shard"]
    rows = out.collect()
    shards = Counter(r.shard for r in rows)
    assert sorted(shards.get(s, 0) for s in range(24)) == sorted(n // 24 + (s < n % 24) for s in range(24))
    for s, size in shards.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size))
    assert sorted(r._file for r in rows) == list(range(n))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_same_rows_same_places(spark, tmp_path):
    cases(spark, 500).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    one, two, other = (sorted(map(tuple, sharding.shard_rows(docs, 24, seed).select("_file", "shard", "slot").collect())) for seed in (7, 7, 8))
    assert one == two != other


def test_partitions_are_spread_over_shards_and_slots(spark):
    docs = spark.range(24_000).select("id").repartition(6, (F.col("id") / 4000).cast("int"))
    rows = sharding.shard_rows(docs, 24, part_rows=100).select("id", "shard", "slot").collect()
    spread = np.zeros((6, 24))
    slots = np.zeros((6, 10))
    for r in rows:
        spread[r.id // 4000, r.shard] += 1
        slots[r.id // 4000, r.slot // 100] += 1
    # Means of 1000 / 6 and 400: six standard deviations either way
    assert abs(spread - 4000 / 24).max() < 6 * (4000 / 24) ** 0.5 and abs(slots - 400).max() < 6 * 20


def test_matrix_has_its_margins_and_the_law_of_the_draws():
    counts = [0, 5, 1000, 3, 0, 77, 1]
    matrix = sharding.Matrix(counts, 24, 1)
    rows = np.stack([matrix.row(p) for p in range(len(counts))])
    assert rows.sum(axis=1).tolist() == counts and rows.sum(axis=0).tolist() == sharding.shard_sizes(sum(counts), 24).tolist() and rows.min() >= 0
    first = [sharding.Matrix([4, 6], 2, seed).row(0)[0] for seed in range(4000)]
    law = [5 / 210, 50 / 210, 100 / 210, 50 / 210, 5 / 210]  # of 5 and 5, four drawn
    seen = np.bincount(first, minlength=5) / 4000
    assert abs(seen - law).max() < 0.04


def test_large_draws_match_the_library(monkeypatch):
    known = [np.random.default_rng(s).hypergeometric(40_000, 90_000, 13_000) for s in range(3000)]
    monkeypatch.setattr(sharding, "LIBRARY_MOST", 10)
    own = [sharding.hypergeometric(40_000, 90_000, 13_000, np.random.default_rng(s)) for s in range(3000)]
    assert abs(np.mean(own) - 4000) < 5 and abs(np.mean(known) - np.mean(own)) < 5 and abs(np.std(own) / np.std(known) - 1) < 0.1
    shares = sharding.share(np.array([7_000_000_000, 0, 5, 3_000_000_000]), 4_000_000_000, np.random.default_rng(1))
    assert shares.sum() == 4_000_000_000 and shares[1] == 0 and shares[2] <= 5 and abs(shares[0] - 2_800_000_000) < 200_000
    assert sharding.hypergeometric(3, 0, 3, np.random.default_rng(1)) == 3 and sharding.hypergeometric(0, 9, 4, np.random.default_rng(1)) == 0
    big = sharding.Matrix([2_000_000_000, 1_000_000_001], 3, 5)
    assert big.row(0).sum() == 2_000_000_000 and (big.row(0) + big.row(1)).tolist() == [1_000_000_001, 1_000_000_000, 1_000_000_000][:3]


def test_written_shards_hold_their_rows_in_order(spark, tmp_path):
    sharded = sharding.shard_rows(cases(spark, 300), 4, part_rows=20)
    sharding.write_shards(sharded, f"{tmp_path}/out", rows_a_file=40)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("_file", "shard", "slot").collect())) == sorted(map(tuple, sharded.select("_file", "shard", "slot").collect()))
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), (F.max("slot") - F.min("slot") + 1).alias("span")).collect()
    assert all(r.n == r.span <= 40 for r in files)


def test_sizes_and_sums(spark):
    docs = spark.createDataFrame([(None,), ("",), ("né 日",)], "text string")
    assert [tuple(r) for r in docs.select(*sharding.sizes(F.col("text"))).collect()] == [(8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for t in (None, "", "né 日")]
