"""Connected components of a table of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node that is reachable.

    Alternates large-star and small-star steps, whose number grows with the logarithm of the longest
    path. A step is a grouped minimum and a join, so that the links of a hot node are pre-aggregated
    and its join can be split. Nodes may be of any type that has an order.
    """
    a, b = F.col("a"), F.col("b")
    edges = cut(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a != b).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(b.alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = cut(small.where(a != b).distinct(), "links")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(a.alias("node"), "root")
    return roots.union(edges.select(b.alias("node"), b.alias("root")).distinct())
