"""The most similar vector by blocks and pivots, against plain Python over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import reid, similar

PROBES = "k string, probe_id long, probe_embedding array<double>"
POOL = "k string, pool_id long, pool_embedding array<double>"


def dot(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def unit(v):
    n = dot(v, v) ** 0.5
    return [x / n for x in v]


def by_pairs(probes, pool, threshold):
    out = {}
    for k, p, u in probes:
        for j, q, v in pool:
            if k is None or k != j or p is None or q is None or p == q or not u or not v or len(u) != len(v) or not all(x is not None and abs(x) < float("inf") for x in u + v):
                continue
            s = dot(u, v)
            if s > threshold and (s, -q) > out.get((k, p), (threshold, 0)):
                out[k, p] = s, -q
    return {key: (-q, s) for key, (s, q) in out.items()}


def clouds(seed, n, centres, spread, dim=6):
    """People seen again and again: vectors around a few centres, one of which holds a third of all."""
    rng = random.Random(seed)
    heart = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [unit([x + rng.gauss(0, spread) for x in heart[0 if rng.random() < 0.34 else rng.randrange(centres)]]) for _ in range(n)]


@pytest.mark.parametrize("block,pivots,spread", [(512, 16, 0.1), (8, 3, 0.1), (5, 1, 2.0)])
def test_equals_all_pairs(spark, block, pivots, spread):
    rng = random.Random(block)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", "d"])
    pool = [(key(), i, v) for i, v in enumerate(clouds(1, 400, 7, spread))]
    pool += [(k, 1000 + i, v) for i, (k, _, v) in enumerate(pool[:60])]  # copies tie; the smaller id wins
    probes = [(key(), rng.choice([i, 5000 + i]), v) for i, v in enumerate(clouds(1, 150, 7, spread))] + [("hot", 7000 + i, pool[i][2]) for i in range(40)]
    found = similar.best_match(spark.createDataFrame(probes, PROBES).repartition(3), spark.createDataFrame(pool, POOL).repartition(5), ["k"], 0.3, block, pivots)
    assert {(r.k, r.probe_id): (r.pool_id, r.similarity) for r in found.collect()} == by_pairs(probes, pool, 0.3)


def test_odd_vectors_take_no_part(spark):
    a, b, nan, inf = [1.0, 0.0], [0.6, 0.8], float("nan"), float("inf")
    pool = [("x", 1, a), ("x", 2, a), ("x", 3, None), ("x", 4, []), ("x", 5, [1.0, None]), ("x", 6, [nan, 1.0]), ("x", 7, [inf, 0.0]), ("x", None, a), (None, 8, a), ("x", 9, [1.0, 0.0, 0.0]), ("y", 10, [0.0, 0.0])]
    probes = [("x", 1, a), ("x", 50, a), ("x", 50, b), ("x", 51, [1.0, 0.0, 0.0]), ("x", 52, None), ("x", 53, [0.0, -1.0]), (None, 54, a), ("y", 55, a), ("z", 56, a), ("x", 57, [2.0])]
    found = similar.best_match(spark.createDataFrame(probes, PROBES).withColumn("other", F.lit(1)), spark.createDataFrame(pool, POOL), ["k"], 0.0)
    assert {(r.k, r.probe_id): (r.pool_id, r.similarity) for r in found.collect()} == {("x", 1): (2, 1.0), ("x", 50): (1, 1.0), ("x", 51): (9, 1.0)} == by_pairs(probes, pool, 0.0)
    assert found.columns == ["k", "probe_id", "pool_id", "similarity"]
    with pytest.raises(ValueError, match="threshold"):
        similar.best_match(spark.createDataFrame(probes, PROBES), spark.createDataFrame(pool, POOL), ["k"], -0.1)


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], POOL), spark.createDataFrame([("x", 1, [1.0])], PROBES)
    assert similar.best_match(some, none, ["k"], 0.1).count() == 0
    assert similar.best_match(spark.createDataFrame([], PROBES), spark.createDataFrame([("x", 2, [1.0])], POOL), ["k"], 0.1).count() == 0


def test_bounds_leave_most_pairs_out(spark):
    """Where people are told apart by their vectors, few blocks can beat what the first ones gave."""
    pool = [("x", i, v) for i, v in enumerate(clouds(3, 3000, 60, 0.02, 8))]
    probes = [("x", 9000 + i, v) for i, v in enumerate(clouds(3, 600, 60, 0.02, 8))]
    _, found = similar.scores(spark.createDataFrame(probes, PROBES), spark.createDataFrame(pool, POOL), ["k"], 0.65, 32)
    assert found.agg(F.sum("_pairs")).first()[0] < 0.35 * len(pool) * len(probes)


def test_blocks_give_the_rows_of_the_join(spark):
    rows = clouds(9, 40, 3, 0.1)
    probes, pool = [("x", i, v) for i, v in enumerate(rows[:20])], [("x", i, v) for i, v in enumerate(rows)]
    p, q = spark.createDataFrame(probes, PROBES), spark.createDataFrame(pool, POOL)
    joined = reid.best_match(p, q, ["k"], 0.65)
    found = similar.best_match(p, q, ["k"], 0.65).select(joined.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) and joined.count() == len(by_pairs(probes, pool, 0.65))
