"""Joins by range and by preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, keys: list[str] | None = None, width: int = 64) -> DataFrame:
    """points joined with every range [low, high] that holds `point`, under equal `keys`.

    Whole numbers are cut into bins of `width`; a range is listed once a bin that it touches and meets its points by
    an ordinary hash join on the bin, so there is no nested loop over points and ranges. Null points, null ends and
    ranges that end before they begin hold nothing.
    """
    keys = keys or []
    at = lambda c: F.floor(c / width)
    binned = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(at(F.col(low)), at(F.col(high)))))
    met = points.where(F.col(point).isNotNull()).withColumn("__bin", at(F.col(point))).join(binned, [*keys, "__bin"])
    return met.where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def preferred(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first known value of (label, value) pairs in order of preference, and the label it came by: what lies locally
    goes before what is declared."""
    return F.coalesce(*[c for _, c in sources]), F.coalesce(*[F.when(c.isNotNull(), n) for n, c in sources])
