"""Running sums and maxima that survive a hot key.

A plain ``sum() over (partition by key order by t)`` sends all rows of a key
to one task.  Here the order column is cut into buckets: rows are windowed
within (key, bucket), bucket totals are accumulated per key, and the two are
joined on (key, bucket).  The join and the window share one hash partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_aggregates(
    df: DataFrame,
    keys: list[str],
    order: str,
    bucket: Column,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running aggregates of each row in its key, in ``order``.

    ``bucket`` must not decrease along ``order``; ``order`` must be unique in a
    key.  Maxima ignore nulls.
    """
    sums, maxima = sums or {}, maxima or {}
    named = [expr.alias(f"__in_{name}") for name, expr in {**sums, **maxima}.items()]
    rows = df.select("*", bucket.alias("__bucket"), *named)
    cell = [*keys, "__bucket"]
    inside = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)

    totals = rows.groupBy(*cell).agg(
        *[F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in sums],
        *[F.max(f"__in_{n}").alias(f"__tot_{n}") for n in maxima],
    )
    before = totals.select(
        *cell,
        *[F.sum(f"__tot_{n}").over(earlier).alias(f"__pre_{n}") for n in sums],
        *[F.max(f"__tot_{n}").over(earlier).alias(f"__pre_{n}") for n in maxima],
    )
    local = rows.select(
        *df.columns,
        "__bucket",
        *[F.sum(f"__in_{n}").over(inside).alias(f"__run_{n}") for n in sums],
        *[F.max(f"__in_{n}").over(inside).alias(f"__run_{n}") for n in maxima],
    )
    joined = local.join(before, cell)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"__run_{n}"), F.lit(0)) + F.coalesce(F.col(f"__pre_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__run_{n}"), F.col(f"__pre_{n}")).alias(n) for n in maxima],
    )
