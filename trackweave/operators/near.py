"""Joins of places that are near in space and soon after in time, on a grid of cells: each row meets only rows of cells that it can reach."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Rows of a cell from which on it is dealt to several keys, so that no key holds more than about so many.
HOT = 4096


def cells_near(x: Column, y: Column, radius: float) -> Column:
    """The cells, of ``radius`` a side, that hold a point within ``radius`` of (x, y): at most nine, as structs of cx and cy."""
    cx, cy = F.floor(x / radius), F.floor(y / radius)
    outside = lambda v, c: F.greatest(c * radius - v, v - (c + 1) * radius, F.lit(0.0))
    around = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((cx + k % 3 - 1).alias("cx"), (cy + F.floor(k / 3) - 1).alias("cy")))
    gap = lambda c: outside(x, c["cx"]) * outside(x, c["cx"]) + outside(y, c["cy"]) * outside(y, c["cy"])
    return F.filter(around, lambda c: gap(c) <= radius * radius * (1 + 1e-9))


def soon_and_near(ends: DataFrame, begins: DataFrame, keys: list[str], radius: float, gap: float, hot: int = HOT, only: Column | None = None) -> DataFrame:
    """Pairs of ``ends`` (keys, x, y, t, ...) and ``begins`` (keys, x, y, t, ...; its columns get ``_b`` at the end) that may lie within ``radius`` and of which the second comes 0 to ``gap`` later.

    A begin lies in one cell of space and time; an end looks into the cells that it can reach, in its own time and the next. Cells with more than
    ``hot`` begins are dealt to several keys, into each of which their ends look. The caller tests the pairs themselves; or gives as ``only`` what a pair must pass, and gets the ends (their own columns, distinct) that
    have such a pair: a cell is then searched for an end until one is found, and no row is made for a pair.
    """
    cell = [*keys, "_cx", "_cy", "_ct"]
    right = begins.select(*keys, F.floor(F.col("x") / radius).alias("_cx"), F.floor(F.col("y") / radius).alias("_cy"), F.floor(F.col("t") / gap).alias("_ct"), *[F.col(c).alias(f"{c}_b") for c in begins.columns if c not in keys])
    now = F.floor(F.col("t") / gap)
    left = ends.withColumn("_cell", F.explode(cells_near(F.col("x"), F.col("y"), radius))).withColumn("_ct", F.explode(F.array(now, now + 1)))
    left = left.withColumn("_cx", F.col("_cell.cx")).withColumn("_cy", F.col("_cell.cy")).drop("_cell")
    full = cut(right.groupBy(*cell).count().where(F.col("count") > hot).select(*cell, F.ceil(F.col("count") / hot).cast("int").alias("_parts")), "hot-cells")

    def met(key: list[str]) -> DataFrame:
        if only is None:
            return left.join(right, key).drop("_cx", "_cy", "_ct", "_part")
        cells = right.withColumnsRenamed({k: f"_r_{k}" for k in key})
        same = reduce(and_, [F.col(k) == F.col(f"_r_{k}") for k in key])
        return left.join(cells, same & only, "left_semi").select(*ends.columns).distinct()

    if full.isEmpty():
        return met(cell)
    right = right.join(full, cell, "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*[c for c in right.columns if c not in cell]), F.col("_parts"))).otherwise(0).cast("int")).drop("_parts")
    left = left.join(full, cell, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return met([*cell, "_part"])
