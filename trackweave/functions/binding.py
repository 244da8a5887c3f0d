"""Naming a value inside an expression, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. A plain Python variable would repeat the whole expression at each use, and nested ones multiply."""
    return F.get(F.transform(F.array(value), body), 0)
