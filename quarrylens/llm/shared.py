"""Tables in the folder that all executors share, and the registry of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import shared_dir
from quarrylens.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """The frame as a written table: computed once, lineage cut, any executor can read it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name)


def tasks(spark: SparkSession) -> int:
    """Partitions for shuffles whose width an operator sets itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pinned(column: Column) -> Column:
    """The same column, below whose projection no filter is moved.

    A filter moved down would fold the arrays of the projections under it into
    its own formula and compute them again for every item.
    """
    return F.when(F.spark_partition_id() >= 0, column)


# A key with this share of all rows is heavy; there are at most as many of them.
HEAVY_KEYS = 1024


def join_weighted(rows: DataFrame, side: DataFrame, on: list[str], weight: str, how: str) -> DataFrame:
    """``rows`` joined with ``side``, whose column ``weight`` counts the rows of its key.

    Keys that hold a thousandth of the counted rows, at most ``HEAVY_KEYS`` of
    them, are broadcast, so the rows of such a key stay spread over the tasks
    they are in.  All others meet in a shuffle.  ``how`` is inner, left_semi
    or left_anti; ``side`` has each key once, and no null keys.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * HEAVY_KEYS >= F.lit(total)
    heavy, light = side.filter(is_heavy), side.filter(~is_heavy)
    others = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    if how == "left_anti":
        return others.join(light, on, how)
    return rows.join(F.broadcast(heavy), on, how).unionByName(others.join(light, on, how))
