"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: list[str | Column], array: Column, item: str, position: str = "__at") -> DataFrame:
    """One row per array item, with its 0-based position.

    The outer form of explode with a filter behind it, not the inner form: for
    that one Catalyst infers a size filter on the generator's input and pushes
    it down, which computes a costly array three times, once before any
    repartitioning.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return rows.filter(F.col(position).isNotNull())
