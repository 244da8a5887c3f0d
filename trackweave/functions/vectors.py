"""Embeddings as arrays: dot product, normalising, blending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def dot(a: Column, b: Column) -> Column:
    """Dot product, the cosine of normalised vectors; 0 if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def normalise(a: Column, floor: float = 1e-12) -> Column:
    """The vector at length 1; lengths below ``floor`` count as ``floor``."""
    length = F.greatest(F.sqrt(dot(a, a)), F.lit(floor))
    return let(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))  # once, not once a component


def blend(old: Column, new: Column, share: float = 0.2) -> Column:
    """Old and new in the given share, normalised; null on either side gives the other."""
    mixed = normalise(F.zip_with(old, new, lambda x, y: x.cast("double") * (1 - share) + y.cast("double") * share))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(mixed)
