"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import settle


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge to another; the smallest id names the component.

    ``edges`` has columns u and v.  Loops and repeated edges change nothing;
    edges with a null end are no edges.
    """

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    current = settle(edges.filter("u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        current = settle(small_star(large_star(current)), "edges")
        now = state(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
