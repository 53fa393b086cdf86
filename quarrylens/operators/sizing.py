"""Broadcasts that are measured first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import shared_dir

# Rows that may be shipped to every task; the rows here are a few numbers and
# one term, so this stays well below the memory of one executor.
BROADCAST_ROWS = 500_000


def fetch_by_key(few: DataFrame, many: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Columns of a large table for a small set of keys.

    When the small side is measured small it is broadcast and the large table
    is only scanned; otherwise the two meet in a shuffle join.
    """
    side, small = settle_small_side(few)
    if not small:
        return side.join(many, key, how)
    if how == "inner":
        return many.join(F.broadcast(side), key)
    # A side cannot be broadcast when its own unmatched rows must be kept, so
    # the large table is cut to the matching rows first.
    found = many.join(F.broadcast(side.select(key).distinct()), key, "left_semi")
    return side.join(found, key, how)


def settle_small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Compute ``df`` once and say whether it may be broadcast.

    At most ``max_rows + 1`` rows are fetched.  If that is all of it, the rows
    become a local table marked for broadcast.  Otherwise the result is
    written to the shared folder and joins against it are left to shuffle:
    Catalyst's own estimate is not trusted, because it sizes exploded text by
    the compressed file it came from.
    """
    spark = df.sparkSession
    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows <= max_rows:
        return F.broadcast(spark.createDataFrame(fetched, schema=df.schema)), True
    path = f"{shared_dir(spark)}/side-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), False
