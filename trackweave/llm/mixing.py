"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

The mix is counted in blocks of equal size in words. Blocks go to sources by the highest quotients
target / (2 * j + 1), then each source's blocks go to its shards by the same rule over the shards'
sizes. A shard is a hash slice of one source's documents in seeded order: a ring of words, of which
the quota is taken from a seeded block on, round after round. So every quota is an integer,
every document is taken as a run of words, and a rerun takes the same.

Hot sources get more shards; blocks go to groups of GROUP shards first, so that no ranking holds more than the groups of one
source or the shards of one group. Only (id, source, size) is ever shuffled. Null texts
have size 0 and are never taken; null sources are one source of their own, the last; null ids are
ordered as an empty string, and rows of equal id by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of sources in order, repeating; words of the mix as a share of all words; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words of a block; words that a shard should have; shards of a group; seed.
BLOCK, SHARD_WORDS, GROUP, SEED = 32, 250_000, 4096, "mix-1"


def seeded(*parts: Column | str) -> Column:
    """Thirty-two hexadecimal digits that look random, from the seed and some values."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def seeded_int(*parts: Column | str) -> Column:
    return F.conv(F.substring(seeded(*parts), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` (double) to rows (source, source_size), one for each source.

    Sources weigh ``weights`` in code point order, null last. What lies above ``passes`` times a
    source's size is shared again by weight. That ends at one level for all sources below their
    cap, found by going through the sources by cap over weight.
    """
    one = F.lit(0)
    place = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = reduce(lambda out, w: out.when(F.col("_place") % len(weights) == w[0], F.lit(float(w[1]))), enumerate(weights), F.when(F.lit(False), F.lit(0.0)))
    rows = sources.withColumn("_place", place).withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * passes).cast("double"))
    everything = Window.partitionBy(one)
    upward = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("_place"))
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_capped", F.col("_cap") * F.col("_rest") <= F.col("_left") * F.col("_weight"))
    free = F.sum(F.when(~F.col("_capped"), F.col("_weight"))).over(everything)
    level = (F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0.0))) / free
    return rows.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * level)).select("source", "source_size", "target")


def apportion(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: of the ``seats`` (the same in all rows of a group) each row's share by Sainte-Lague.

    The last winning quotient lies near sum(weight) / seats, off by at most half a seat for each row.
    So all seats but about three a row are known at once, and only the others are ranked.
    """
    own = Window.partitionBy(*(group or [F.lit(0)]))
    n, total, w = F.count(F.lit(1)).over(own), F.sum(F.col(weight).cast("double")).over(own), F.col(weight).cast("double")
    around = lambda sign: F.floor(w * (F.col(seats) + sign * F.col("_n") / 2) / F.col("_sum") + 0.5)
    rows = rows.withColumn("_n", n.cast("double")).withColumn("_sum", total)
    rows = rows.withColumn("_sure", F.when(F.col("_sum") > 0, F.greatest(F.lit(0), around(-1) - 1)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("_most", F.when(F.col("_sum") > 0, F.greatest(F.col("_sure"), around(1) + 1)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(own))
    tried = rows.withColumn("_j", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
    rank = F.row_number().over(own.orderBy((w / (2 * F.col("_j") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("_j")))
    won = tried.withColumn("_won", (rank <= F.col("_open")) & (w > 0))
    keys = [c for c in rows.columns if not c.startswith("_")] + ["_sure"]
    return won.groupBy(*keys).agg(F.sum(F.col("_won").cast("long")).alias("_more")).withColumn("quota", F.col("_sure") + F.col("_more")).drop("_sure", "_more")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, group: int = GROUP, seed: str = SEED) -> DataFrame:
    """For each row of ``docs``: doc_id, source, size, source_size, target, taken (words), and the run's copies.

    ``taken`` is at most ``passes`` times ``size``; a source's sum of it is its target to within a
    block, plus at most half a block for each shard of a source at its cap.
    """
    sized = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    whole = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, passes, weights)
    whole = whole.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    # One row for each source: read several times below, made from the narrow table of sizes each time.
    whole = apportion(whole, [], ["source"], "target", "seats").withColumnRenamed("quota", "blocks")
    whole = whole.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")).drop("seats")
    whole = cut(whole, "sources").withColumnRenamed("source", "_s")
    dealt = sized.join(whole, sized["source"].eqNullSafe(F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("shard", F.pmod(seeded_int(seed, F.col("doc_id")), F.col("n_shards")))
    own = Window.partitionBy("source", "shard").orderBy(seeded(seed, F.col("doc_id")), "size")
    dealt = dealt.withColumn("_end", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("ring"), F.first("blocks").alias("blocks"))
    shards = shards.withColumn("part", F.floor(F.col("shard") / group))
    parts = apportion(shards.groupBy("source", "part").agg(F.sum("ring").alias("whole"), F.first("blocks").alias("blocks")), ["source"], ["part"], "whole", "blocks")
    parts = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.col("quota").alias("part_blocks"))
    shards = shards.join(parts, shards["source"].eqNullSafe(F.col("_s")) & (shards["part"] == F.col("_p"))).drop("_s", "_p")
    shards = apportion(shards, ["source", "part"], ["shard"], "ring", "part_blocks")
    shards = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_shard"), "ring", F.least(F.col("quota") * block, F.col("ring") * passes).alias("_quota"))
    shards = shards.withColumn("_start", F.pmod(seeded_int(seed, F.col("_s"), F.col("_shard")), F.greatest(F.lit(1), F.ceil(F.col("ring") / block))) * block)
    out = dealt.join(shards, dealt["source"].eqNullSafe(F.col("_s")) & (dealt["shard"] == F.col("_shard")))
    ring, begin, end = F.greatest(F.col("ring"), F.lit(1)), F.col("_end") - F.col("size"), F.col("_end")
    rest, start = F.col("_quota") % ring, F.col("_start")
    within = lambda low, high: F.greatest(F.lit(0), F.least(end, high) - F.greatest(begin, low))
    run = within(start, start + rest) + within(start - ring, start + rest - ring)
    taken = F.floor(F.col("_quota") / ring) * F.col("size") + run
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
