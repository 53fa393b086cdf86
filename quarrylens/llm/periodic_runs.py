"""Periodic runs of words in documents, found in tiles by octaves of the period.

A run is a longest stretch of words with smallest period q, of at least
``LEAST_WORDS`` words and ``LEAST_TURNS`` periods.

1. Octave 0 holds the periods 1 to 8, octave k those in (s, 2 s] for the step
   s = 8 * 2**(k - 1).  Boundaries lie at all multiples of the step.  A run contains a
   boundary c in its first period, and the s words from c come again at c + q.  Where
   no block comes again at a distance of its octave, nothing is kept: block hashes
   of all boundaries, made by doubling, are compared for each octave.
2. Tiles of 16 boundaries, with a step of words before and three behind them, are
   exploded to rows and dealt over the tasks, so that a long document is solved in
   many places.
3. In its tile a boundary is solved alone: the Z-function of what follows it tells
   how far each period holds to the right, that of the reversed words how far to
   the left.  A period with a divisor that holds as well is not the smallest one.
   Stretches that end inside the tile and are too short go.
4. Stretches are shuffled by (document, period).  Two that share a whole period
   are one; what is long enough then is a run.

Null and empty texts, and texts without words, have no runs and stay empty when
collapsed.  Each row counts for itself, whether its doc_id repeats or is null.
Very long texts are cut into tiles like all others.  An empty table gives no
rows.  Other columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.shared import settle, tasks
from quarrylens.llm.shingles import mixed, slices

LEAST_WORDS, LEAST_TURNS = 24, 3
# The periods of octave 0, and the step between its boundaries.
SMALL = 8
# Boundaries of a tile.
BOUNDARIES = 16
# Steps of words before a boundary and after it that it is solved on.
BEFORE, AFTER = 1, 4
# Words of tiles that a task solves.
TASK_WORDS = 1 << 19
# Texts, and bytes of them, that are tiled together.
TEXTS, TEXT_BYTES = 512, 2 << 20

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FACTOR = np.uint64(0xD1342543DE82EF95)

_TILES = "array<struct<step:int,start:int,last:boolean,ids:array<int>,at:array<int>,period:array<int>,stride:array<int>,times:array<int>>>"
_RUNS = "array<struct<start:long,length:long,period:long>>"


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(step, least period, largest period) of the octaves in which n words can hold a run."""
    step, low, high = SMALL, 1, SMALL
    while LEAST_TURNS * low <= n and n >= LEAST_WORDS:
        yield step, low, high
        step, low, high = (SMALL, high + 1, 2 * SMALL) if low == 1 else (2 * step, high + 1, 2 * high)


def seeds(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each octave its step, boundaries and the distances at which their blocks come again.

    ``ids`` are the words of several texts behind one another, ``bounds`` where
    the texts begin and end.  Hashes may suggest a block too many, never miss one.
    """
    n = len(ids)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    begins = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(n)
    hashes, size = mixed(ids.astype(np.uint64) + np.uint64(1)), 1
    for step, low, high in octaves(int(np.diff(bounds).max(initial=0))):
        while size < step and len(hashes) > size:
            hashes = mixed(hashes[:-size] * _FACTOR + hashes[size:])
            size *= 2
        if size < step:
            return
        whole = place[: len(hashes)]
        if low == 1:
            kept = []
            for period in range(low, high + 1):
                c = np.arange(0, max(0, len(hashes) - period), step)
                c = c[(hashes[c] == hashes[c + period]) & (c + period + step <= ends[c])]
                if len(c):
                    kept.append((c, np.full(len(c), period)))
            if kept:
                yield step, *map(np.concatenate, zip(*kept))
        else:
            c = np.maximum(((whole - 1) // step - 1) * step, 0)
            same = (hashes[c] == hashes) & (whole - c >= low) & (whole - c <= high)
            same &= (c >= begins[: len(hashes)]) & (whole + step <= ends[: len(hashes)])
            at = np.flatnonzero(same)
            if len(at):
                yield step, c[at], at - c[at]


def progressions(at: np.ndarray, period: np.ndarray) -> list[np.ndarray]:
    """Sorted (boundary, period) pairs as (boundary, first period, stride, times).

    A block that comes again many times within its own length does so at equal
    distances, so a boundary of a text of one repeated word has one row, not a
    row for each period.
    """
    same = np.append(False, at[1:] == at[:-1])
    stride = np.where(same, np.diff(period, prepend=0), 0)
    goes_on = same & (~np.append(False, same[:-1]) | (stride == np.append(0, stride[:-1])))
    first = np.flatnonzero(~goes_on)
    times = np.diff(np.append(first, len(at)))
    second = np.minimum(first + 1, len(at) - 1)
    return [at[first], period[first], np.where(times > 1, period[second] - period[first], 1), times]


def tiles_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
    """The tiles of each text; places in a tile are counted from its first word."""
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    for step, boundaries, periods in seeds(ids, bounds):
        order = np.lexsort((periods, boundaries))
        at, period, stride, times = progressions(boundaries[order], periods[order])
        text, number = np.searchsorted(bounds, at, side="right") - 1, at // (step * BOUNDARIES)
        cuts = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (number[1:] != number[:-1])))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            t, first = int(text[a]), int(number[a]) * step * BOUNDARIES
            low = max(int(bounds[t]), first - BEFORE * step)
            high = min(int(bounds[t + 1]), first + (BOUNDARIES - 1 + AFTER) * step)
            tile = {"step": step, "start": low - int(bounds[t]), "last": high == bounds[t + 1], "ids": ids[low:high]}
            out[t].append(tile | {"at": at[a:b] - low, "period": period[a:b], "stride": stride[a:b], "times": times[a:b]})
    return out


def word_numbers(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal for equal words of any of the texts, and the bounds of the texts."""
    numbers: dict[str, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)) for words in texts]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(i) for i in ids], out=bounds[1:])
    return np.concatenate([np.zeros(0, np.int32), *ids]), bounds


def tiled(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own), words joined by one space, tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("doc_id", pa.int64()), ("row", pa.int64()), ("words", pa.string()),
                ("tiles", pa.list_(pa.struct([
                    ("step", pa.int32()), ("start", pa.int32()), ("last", pa.bool_()), ("ids", pa.list_(pa.int32())),
                    *[(c, pa.list_(pa.int32())) for c in ("at", "period", "stride", "times")],
                ]))),
            ]
        )
        for batch in slices(batches, 2, TEXTS, TEXT_BYTES):
            texts = [WORD.findall(t or "") for t in batch.column(2).to_pylist()]
            tiles = tiles_of(*word_numbers(texts))
            columns = [batch.column(0), batch.column(1), pa.array([" ".join(w) for w in texts], pa.string()), pa.array(tiles, schema.field("tiles").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, f"doc_id long, row long, words string, tiles {_TILES}")


def z_function(items: list[int], upto: int) -> list[int]:
    """For each place up to ``upto``, how many items from there equal those from the start."""
    n = len(items)
    z = [0] * min(n, upto + 1)
    if z:
        z[0] = n
    low = high = 0
    for i in range(1, len(z)):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and items[k] == items[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def solved(
    ids: list[int], step: int, start: int, last: bool, at: list[int], period: list[int], stride: list[int], times: list[int]
) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches that a tile's boundaries see, counted from the text's first word."""
    asked: dict[int, list[np.ndarray]] = defaultdict(list)
    for c, p, s, n in zip(at, period, stride, times):
        asked[c].append(p + s * np.arange(n))
    stretches: dict[int, list[list[int]]] = defaultdict(list)
    for c, parts in sorted(asked.items()):
        periods = np.concatenate(parts)
        top = int(periods.max())
        low, high = max(0, c - BEFORE * step), min(len(ids), c + AFTER * step)
        reach = np.array(z_function(ids[c:high], top)) + np.arange(top + 1)
        reach[0] = 0
        # The least period of the words from the boundary on; one that divides another rules that out.
        least = np.searchsorted(np.maximum.accumulate(reach), reach[periods])
        periods = periods[(least == periods) | (periods % np.maximum(least, 1) != 0)]
        left = ids[low:c][::-1]
        behind = z_function([*left, -1, *ids[low : c + top][::-1]], len(left) + 1 + top) if len(periods) else []
        for p in periods.tolist():
            a, b = c - min(behind[len(left) + 1 + top - p], len(left)), c + int(reach[p])
            # Words before the window or behind it may go on with the period.
            cut = (a == low and (start or low)) or (b == high and not (last and high == len(ids)))
            if not cut and b - a < max(LEAST_WORDS, LEAST_TURNS * p):
                continue
            own = stretches[p]
            if own and a <= own[-1][1] - p:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
    return [(p, a + start, b + start) for p, own in stretches.items() for a, b in own]


def stretches(rows: DataFrame) -> DataFrame:
    """(row, period, start, end) that the tiles see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row, tile in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.extend((row, *stretch) for stretch in solved(**tile.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "period", "start", "end"])

    n_words = rows.agg(F.sum(F.aggregate("tiles", F.lit(0), lambda n, t: n + F.size(t["ids"])))).first()[0] or 0
    parts = max(tasks(rows.sparkSession), -(-n_words // TASK_WORDS))
    tiles = rows.select("row", F.explode("tiles").alias("tile")).repartition(parts, "row", "tile.step", "tile.start")
    return tiles.mapInArrow(run, "row long, period long, start long, end long")


def stitched(parts: DataFrame) -> DataFrame:
    """(row, runs): stretches of a row and period that share a whole period are one."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("fresh", F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True)).cast("int"))
    islands = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("row", "period", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    long_enough = joined.filter(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TURNS * F.col("period")))
    # A text of n words has fewer than n runs.
    return long_enough.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for words, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if runs:
                split = words.split(" ")
                edges = np.zeros(len(split) + 1, dtype=np.int64)
                for run in runs:
                    edges[run["start"] + run["period"]] += 1
                    edges[run["start"] + run["length"]] -= 1
                kept = np.cumsum(edges[:-1]) == 0
                words = " ".join(w for w, k in zip(split, kept.tolist()) if k)
            texts.append(words)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string())], ["doc_id", "row", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed of every row of (doc_id, text).

    ``runs`` holds (start, length, period) in words, by start, then period.
    ``collapsed`` joins by one space the words that no run repeats: of a run the
    first period stays.
    """
    rows = settle(tiled(docs), "tiles")
    has_tiles = F.size("tiles") > 0
    runs = stitched(stretches(rows.filter(has_tiles)))
    none = F.lit(None).cast(_RUNS)
    met = rows.filter(has_tiles).select("doc_id", "row", "words").join(runs, "row", "left")
    met = met.select("doc_id", "row", "words", F.coalesce(F.col("runs").cast(_RUNS), F.array().cast(_RUNS)).alias("runs"))
    repeated = met.mapInArrow(_collapsed, f"doc_id long, row long, runs {_RUNS}, collapsed string")
    plain = rows.filter(~has_tiles).select("doc_id", "row", F.coalesce(none, F.array().cast(_RUNS)).alias("runs"), F.col("words").alias("collapsed"))
    return repeated.unionByName(plain).select("doc_id", "runs", "collapsed")


def run_digests(found: DataFrame) -> DataFrame:
    """Per row: number of runs, the run with most turns, and digests of runs and collapsed text."""
    turns = lambda r: r["length"].cast("double") / r["period"]
    # Quotients of numbers below 2**26 differ as doubles where they differ.
    ranked = F.array_sort(F.transform("runs", lambda r: F.struct((-turns(r)).alias("turns"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    best = F.get(ranked, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("*", best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
