"""Exact percentiles, in the three definitions in use.

Sorting a hot group in one task, or holding its values in one aggregation
buffer, does not scale.  Instead the wanted rank is closed in by rounds: a
mergeable sketch of what lies between two values gives a grid of quantiles, the
two around the rank become the new ends, and one count tells how many rows lie
below, at and between them.  A rank at an end is answered there, however many
rows share that value; otherwise the ends themselves are left out of the next
round, so each round makes progress on any distribution.  A round leaves about
a five-hundredth of the rows.  At most ``FEW`` values of a rank are
sorted at last.  Nothing is approximated, and there is no window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.sizing import settle_small_side

SKETCH_ACCURACY = 10_000
# Quantiles of a sketch; the grid is wider than the sketch's error.
GRID = 1000
# Values between the ends of a rank that are sorted in the last step.
FEW = 1 << 17


@dataclass(frozen=True)
class RankTarget:
    """A wanted 1-based rank: about where it lies, and its exact formula of n."""

    fraction: float
    rank: Callable[[Column], Column]


def floor_rank(percent: int) -> RankTarget:
    return RankTarget(percent / 100, lambda n: F.greatest(F.lit(1), F.floor(n * percent / 100)))


def ceil_rank(percent: int) -> RankTarget:
    return RankTarget(percent / 100, lambda n: F.greatest(F.lit(1), F.ceil(n * percent / 100)))


def _exclusive_low(percent: int) -> Callable[[Column], Column]:
    return lambda n: F.least(F.greatest(F.floor(percent * (n + 1) / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))


def _next(rank: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda n: F.least(rank(n) + 1, n)


def values_at_ranks(df: DataFrame, keys: list[str], value: str, targets: dict[str, RankTarget]) -> DataFrame:
    """Per group: ``n`` and the value at each target's rank.  Nulls are ignored."""
    rows = df.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    ends = _first_ends(rows, keys, targets)
    open_values = lambda frame: frame.agg(F.max(F.array_max(F.transform("__ends", _between)))).first()[0] or 0
    # Few values from the start need neither sketch nor count.
    few = open_values(ends) <= FEW
    while not few:
        ends = _kept(_counted(rows, ends, keys, len(targets)))
        few = open_values(ends) <= FEW
        if not few:
            ends = _closer(rows, ends, keys, len(targets))
    out = []
    for i, name in enumerate(targets):
        end = F.col("__ends")[i]
        held = F.sort_array(F.collect_list(F.when(_inside(end), F.col("__v"))))
        found = F.get(held, (F.first(end["rank"]) - F.first(end["below"]) - 1).cast("int"))
        out.append(F.coalesce(F.first(end["value"]), found).alias(name))
    return _with_ends(rows, ends, keys).groupBy(*keys).agg(F.count("*").alias("n"), *out)


def _between(end: Column) -> Column:
    """Rows strictly between the ends of a rank; none once it is answered."""
    return F.when(end["value"].isNull(), end["inside"]).otherwise(0)


def _inside(end: Column) -> Column:
    """Whether a row's value lies strictly between the ends; an absent end is no end."""
    above = end["low"].isNull() | (F.col("__v") > end["low"])
    return end["value"].isNull() & above & (end["high"].isNull() | (F.col("__v") < end["high"]))


def _end(rank: Column, low: Column, high: Column, below: Column, inside: Column, value: Column, left: Column, right: Column) -> Column:
    """State of a rank: rows up to ``low``, rows between the ends, the answer; and the ends to be tried next."""
    return F.struct(
        rank.alias("rank"), low.alias("low"), high.alias("high"), below.cast("long").alias("below"), inside.cast("long").alias("inside"),
        value.alias("value"), left.alias("left"), right.alias("right"),
    )


def _around(grid: Column, share: Column) -> tuple[Column, Column]:
    """The quantiles a cell below and above a share of the rows."""
    at = lambda k: F.get(grid, F.greatest(F.lit(0), F.least(F.lit(GRID), k)).cast("int"))
    return at(F.floor(share * GRID) - 1), at(F.ceil(share * GRID) + 1)


def _first_ends(rows: DataFrame, keys: list[str], targets: dict[str, RankTarget]) -> DataFrame:
    quantiles = [k / GRID for k in range(GRID + 1)]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", quantiles, SKETCH_ACCURACY).alias("__grid"))
    none = F.lit(None).cast(rows.schema["__v"].dataType)
    ends = []
    for target in targets.values():
        rank = target.rank(F.col("__n")).cast("long")
        ends.append(_end(rank, none, none, F.lit(0), F.col("__n"), none, *_around(F.col("__grid"), rank / F.col("__n"))))
    return _kept(bounds.filter("__n > 0").select(*keys, F.array(*ends).alias("__ends")))


def _counted(rows: DataFrame, ends: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One count of the rows around the tried ends; each rank takes the part that holds it."""
    counts = []
    for i in range(n):
        end = F.col("__ends")[i]
        for name, side in (("left", "low"), ("right", "high")):
            inside = _inside(end)
            counts.append(F.count_if(inside & (F.col("__v") < end[name])).alias(f"__{name}{i}"))
            counts.append(F.count_if(inside & (F.col("__v") <= end[name])).alias(f"__upto_{name}{i}"))
    met = _with_ends(rows, ends, keys).groupBy(*keys).agg(F.first("__ends").alias("__ends"), *counts)
    fixed = []
    for i in range(n):
        end = F.col("__ends")[i]
        place = end["rank"] - end["below"]
        left, upto_left, right, upto_right = (F.col(f"__{c}{i}") for c in ("left", "upto_left", "right", "upto_right"))
        case = lambda *parts: F.when(place <= left, parts[0]).when(place <= upto_left, parts[1]).when(place <= right, parts[2]).when(place <= upto_right, parts[3]).otherwise(parts[4])
        fixed.append(
            F.when(end["value"].isNotNull(), end).otherwise(
                _end(
                    end["rank"],
                    case(end["low"], end["low"], end["left"], end["low"], end["right"]),
                    case(end["left"], end["high"], end["right"], end["high"], end["high"]),
                    end["below"] + case(F.lit(0), F.lit(0), upto_left, F.lit(0), upto_right),
                    case(left, F.lit(0), right - upto_left, F.lit(0), end["inside"] - upto_right),
                    F.when((place > left) & (place <= upto_left), end["left"]).when((place > right) & (place <= upto_right), end["right"]),
                    end["left"],
                    end["right"],
                )
            )
        )
    return met.select(*keys, F.array(*fixed).alias("__ends"))


def _closer(rows: DataFrame, ends: DataFrame, keys: list[str], n: int) -> DataFrame:
    """New ends to try, from a sketch of the rows strictly between the present ones."""
    quantiles = [k / GRID for k in range(GRID + 1)]
    grids = [F.percentile_approx(F.when(_inside(F.col("__ends")[i]), F.col("__v")), quantiles, SKETCH_ACCURACY).alias(f"__grid{i}") for i in range(n)]
    met = _with_ends(rows, ends, keys).groupBy(*keys).agg(F.first("__ends").alias("__ends"), *grids)
    tried = []
    for i in range(n):
        end = F.col("__ends")[i]
        left, right = _around(F.col(f"__grid{i}"), (end["rank"] - end["below"]) / F.greatest(end["inside"], F.lit(1)))
        tried.append(_end(*(end[c] for c in ("rank", "low", "high", "below", "inside", "value")), left, right))
    return _kept(met.select(*keys, F.array(*tried).alias("__ends")))


def _kept(ends: DataFrame) -> DataFrame:
    """One row for each group, computed once: local if there are few, else a table."""
    return settle_small_side(ends)[0]


def _with_ends(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the state of its group to each row."""
    if keys:
        return rows.join(ends, keys)
    only = ends.first()
    state = F.lit(None).cast(ends.schema["__ends"].dataType)
    if only is not None:
        kind = ends.schema["__ends"].dataType.elementType
        state = F.array(*[F.struct(*[F.lit(e[f.name]).cast(f.dataType).alias(f.name) for f in kind]) for e in only["__ends"]])
    return rows.select("*", state.alias("__ends"))


def percentile_floor(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Value at rank floor(n p / 100), at least the first."""
    return values_at_ranks(df, keys, value, {f"p{p}": floor_rank(p) for p in percents})


def percentile_ceil(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Value at rank ceil(n p / 100), at least the first."""
    return values_at_ranks(df, keys, value, {f"p{p}": ceil_rank(p) for p in percents})


def percentile_exclusive(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Linear between neighbours at p (n + 1) / 100, extrapolating at the ends.

    With the position clamped to the second-last value the weight is not, so
    high percentiles of few values pass the maximum.  One value is itself.
    """
    targets: dict[str, RankTarget] = {}
    for p in percents:
        low = _exclusive_low(p)
        targets[f"p{p}_low"] = RankTarget(p / 100, low)
        targets[f"p{p}_high"] = RankTarget(p / 100, _next(low))
    found = values_at_ranks(df, keys, value, targets)
    n = F.col("n")
    columns = []
    for p in percents:
        delta = p * (n + 1) - 100 * _exclusive_low(p)(n)
        low, high = F.col(f"p{p}_low"), F.col(f"p{p}_high")
        columns.append(F.when(n == 1, low).otherwise((low * (100 - delta) + high * delta) / 100).alias(f"p{p}"))
    return found.select(*keys, "n", *columns)
