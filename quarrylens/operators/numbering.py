"""Dense numbers for ids of any type."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.session import shared_dir


def settled(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, id: str, name: str, base: int = 0) -> DataFrame:
    """``df`` with a number for each row: base, base + 1, ... in the order of the id column.

    Spark range-partitions the rows by id; a row's number is its place in its
    partition plus the rows of the partitions before.  Only the sizes of the
    partitions, one row each, meet in a window and are broadcast.
    """
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = df.repartitionByRange(width, id).sortWithinPartitions(id)
    place = F.monotonically_increasing_id()
    placed = settled(ordered.select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").count()
    shifts = sizes.select("__part", (F.coalesce(F.sum("count").over(before), F.lit(0)) + base).alias("__shift"))
    met = placed.join(F.broadcast(shifts), "__part")
    return met.select(*df.columns, (F.col("__place") + F.col("__shift")).alias(name))


def is_whole(df: DataFrame, column: str) -> bool:
    """Whether a column already holds whole numbers."""
    return df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
