"""Approximate percentiles over any period from stored, mergeable sketches.

Each hour of each key is one KLL sketch of a value.  The table grows with hours
and keys, not with rows; late rows add further sketches of the same hour.  A
period is answered by merging its sketches, without reading the log again.
Estimates have a rank within ``RANK_ERROR`` of the wanted one; for exact values
use :mod:`quarrylens.operators.percentiles`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size parameter of a sketch, and a rank error that it keeps with wide margin
# (its normalized error is below 0.0035 in 99 of 100 cases).
SKETCH_SIZE = 800
RANK_ERROR = 0.01


def hourly_sketches(log: DataFrame, ts: str, keys: list[str], values: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(hour, keys, one sketch for each value).  Nulls and NaN are left out; a sketch may be empty.

    Sketches are filled before the exchange, so a busy hour sends one per task.
    """
    clean = [F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias(v) for v in values]
    rows = log.select(F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour"), *keys, *clean)
    return rows.groupBy("hour", *keys).agg(*[F.kll_sketch_agg_double(v, size).alias(v) for v in values])


def merged_sketches(
    sketches: DataFrame, keys: list[str], values: list[str], since: dt.datetime | None = None, until: dt.datetime | None = None
) -> DataFrame:
    """(keys, one sketch for each value) over the hours from ``since`` up to, not with, ``until``."""
    hours = sketches
    if since is not None:
        hours = hours.filter(F.col("hour") >= F.lit(since))
    if until is not None:
        hours = hours.filter(F.col("hour") < F.lit(until))
    return hours.groupBy(*keys).agg(*[F.kll_merge_agg_double(v).alias(v) for v in values])


def count(sketch: Column) -> Column:
    """Values that a sketch has seen; exact."""
    return F.kll_sketch_get_n_double(sketch)


def percentile(sketch: Column, percent: float) -> Column:
    """About the value at a percentile; null for an empty sketch."""
    return F.when(count(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(percent / 100)))


def share_upto(sketch: Column, value: float) -> Column:
    """About the share of values up to ``value``; null for an empty sketch."""
    return F.when(count(sketch) > 0, F.kll_sketch_get_rank_double(sketch, F.lit(float(value))))
