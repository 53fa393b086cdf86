"""Top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are ranked at this many decimals: sums of the same terms taken in
# another order differ by rounding noise only, and must tie.
SCORE_DECIMALS = 9


def settle(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, with their 1-based rank.

    Spark prunes each partition to ``k`` rows per group before the exchange
    (window group limit), so a hot group sends k rows per task, not all.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
