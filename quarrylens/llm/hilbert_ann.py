"""Nearest neighbours by cosine along several Hilbert orderings.

Each ordering turns the unit vectors by a random rotation, keeps a few
coordinates, shifts the grid, and numbers the cells along a Hilbert curve.
Spark range-partitions the vectors by (ordering, key); ranks follow from the
partition sizes.  Every query looks at the ranks around its own in every
ordering, block by block, and the best of all windows are merged and scored on
the original vectors.

Equal vectors are one point of the index with its smallest ids, since a query
needs no more of them than it returns; so a vector that fills a third of the
table is one row.  A window spans a fixed number of points and a fixed share of
them to either side: nearness in many dimensions thins out with the size of the
table, and the share holds recall where it was measured.

Vectors that are null, zero, or hold null or non-finite components take no
part.  Only vectors of equal dimension meet.  Repeated rows count once; a
candidate with the query's own id is never returned, ties go to the smaller id.
Rows without id take no part.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.minhash_dedup import _runs
from quarrylens.llm.shared import settle

NEAREST = 5
EVERY = 50
ORDERINGS = 24
AXES, BITS = 8, 7
# Points to either side of a query in each ordering: a number, and a share of all.
AROUND = 200
SHARE = 0.02
# Points of one block of an ordering.
BLOCK = 1024
_SEED = 7919


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid cell on the Hilbert curve.

    ``cells`` is (points, axes) of integers below 2**bits.  Walks from the
    coarsest to the finest halving of the grid: each undoes the reflections and
    exchanges of axes of its sub-cube, and Gray code orders the corners.
    """
    axes = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    zero = np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k in range(len(axes)):
            set_here = (axes[k] & bit) != zero
            swap = np.where(set_here, zero, (axes[0] ^ axes[k]) & low)
            axes[0] = np.where(set_here, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((axes[-1] & np.uint64(1 << level)) != zero, np.uint64((1 << level) - 1), zero)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ flips) >> np.uint64(level)) & np.uint64(1))
    return key


def ordering_keys(units: np.ndarray, ordering: int) -> np.ndarray:
    """Hilbert keys of unit vectors in one ordering: rotated, projected, shifted."""
    width = units.shape[1]
    rng = np.random.default_rng([_SEED, ordering, width])
    axes = min(AXES, width)
    turned = units @ np.linalg.qr(rng.normal(size=(width, axes)))[0]
    # Components of a random unit vector spread by 1 / sqrt(width); a logistic
    # curve makes the cells about equally full.
    level = 1.0 / (1.0 + np.exp(-1.7 * math.sqrt(width) * turned))
    shifted = (level + rng.random(axes)) / 2.0
    cells = np.minimum((shifted * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_keys(cells, BITS).astype(np.int64)


def _vector(cell: pa.Scalar) -> np.ndarray | None:
    """A vector that takes part, in double precision."""
    values = cell.values if cell.is_valid else None
    if values is None or not len(values) or values.null_count:
        return None
    vector = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return vector if np.isfinite(vector).all() and vector.any() else None


def points(vectors: DataFrame, nearest: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their smallest ids, and the queries with their vector's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = _vector(cell)
                if key is not None and vector is not None:
                    # Adding zero turns minus zero into zero: equal vectors, equal bytes.
                    found.setdefault((vector + 0.0).tobytes(), []).append(key)
            rows = []
            for raw, ids in found.items():
                digest = hashlib.blake2b(raw, digest_size=16).digest()
                for k, key in enumerate(sorted(set(ids))):
                    if k <= nearest or key % every == 0:
                        rows.append((digest, raw, key, k <= nearest, key % every == 0))
            if rows:
                types = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["digest", "vector", "id", "small", "asks"])

    kept = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "digest binary, vector binary, id long, small boolean, asks boolean")
    kept = settle(kept, "vectors")
    small = F.collect_set(F.when(F.col("small"), F.col("id")))
    classes = kept.groupBy("digest").agg(
        F.first("vector").alias("vector"), F.slice(F.sort_array(small), 1, nearest + 1).alias("ids"), F.max("asks").alias("asks"), F.min("id").alias("point")
    )
    return settle(classes, "points"), kept.filter("asks").select("digest", F.col("id").alias("query_id")).distinct()


def ranked(classes: DataFrame, orderings: int) -> DataFrame:
    """(ordering, dimension, rank, point, asks) of every point in every ordering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            raws = batch.column(1).to_pylist()
            for k, raw in enumerate(raws):
                by_width.setdefault(len(raw) // 8, []).append(k)
            for width, rows in by_width.items():
                matrix = np.frombuffer(b"".join(raws[k] for k in rows), np.float64).reshape(-1, width)
                # Scaled by the largest component first, so that no square overflows.
                units = matrix / np.abs(matrix).max(axis=1, keepdims=True)
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                part = batch.take(pa.array(rows))
                for ordering in range(orderings):
                    n = len(rows)
                    columns = [pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, ordering, np.int32)), pa.array(ordering_keys(units, ordering)), part.column(0), part.column(2)]
                    yield pa.RecordBatch.from_arrays(columns, ["dimension", "ordering", "key", "point", "asks"])

    keyed = classes.select("point", "vector", "asks").mapInArrow(run, "dimension int, ordering int, key long, point long, asks boolean")
    keyed = settle(keyed, "keys")
    width = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # The id in the sort key cuts runs of equal keys too.
    ordered = keyed.repartitionByRange(width, "dimension", "ordering", "key", "point").sortWithinPartitions("dimension", "ordering", "key", "point")
    place = F.monotonically_increasing_id()
    ordered = settle(ordered.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ordered")
    # One row for each partition and ordering in it.
    sizes = ordered.groupBy("dimension", "ordering", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("dimension", "ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("dimension", "ordering", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    met = ordered.join(F.broadcast(shifts), ["dimension", "ordering", "part"])
    return met.select("dimension", "ordering", (F.col("place") + F.col("shift")).alias("rank"), "point", "asks")


def _scored(nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, 3):
            asks = np.asarray(block.column("asks"))
            if asks.all() or not asks.any():
                continue
            raws, ids, point = block.column("vector").to_pylist(), block.column("ids").to_pylist(), np.asarray(block.column("point"))
            width = len(raws[0]) // 8
            matrix = np.frombuffer(b"".join(raws), np.float64).reshape(-1, width)
            matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            own = np.flatnonzero(~asks)
            units = matrix[own] / norms[own][:, None]
            out: list[tuple[int, int, float]] = []
            for q in np.array_split(np.flatnonzero(asks), max(1, int(asks.sum()) // 256)):
                if not len(q):
                    continue
                near = (matrix[q] / norms[q][:, None]) @ units.T
                # A few more than asked for, so that rounding does not decide.
                few = min(nearest + 4, near.shape[1])
                top = np.argpartition(-near, few - 1, axis=1)[:, :few]
                for row, best in zip(q.tolist(), top):
                    at = own[best]
                    exact = (matrix[at] * matrix[row]).sum(axis=1) / (norms[at] * norms[row])
                    ranked_ids = sorted((-float(s), key) for s, k in zip(exact, at.tolist()) for key in ids[k])
                    out.extend((int(point[row]), key, -s) for s, key in ranked_ids[: nearest + 1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["point", "id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY, orderings: int = ORDERINGS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for every row of (vec_id, embedding) whose id is divisible by ``every``."""
    classes, queries = points(vectors, nearest, every)
    places = settle(ranked(classes, orderings), "places")
    counts = places.filter("ordering = 0").groupBy("dimension").agg(F.count("*").alias("points"))
    reach = F.lit(AROUND) + F.ceil(F.col("points") * share)
    # One row for each dimension that occurs in the table.
    asking = places.filter("asks").join(counts, "dimension").select("*", reach.alias("reach"))
    first = F.floor(F.greatest(F.col("rank") - F.col("reach"), F.lit(0)) / BLOCK)
    last = F.floor(F.least(F.col("rank") + F.col("reach"), F.col("points") - 1) / BLOCK)
    looks = asking.select("dimension", "ordering", F.explode(F.sequence(first, last)).alias("block"), F.lit(True).alias("asks"), "point")
    held = places.select("dimension", "ordering", F.floor(F.col("rank") / BLOCK).alias("block"), F.lit(False).alias("asks"), "point")
    rows = held.unionByName(looks).join(classes.select("point", "vector", "ids"), "point")
    rows = rows.select("dimension", "ordering", "block", "asks", "point", "vector", "ids")
    rows = rows.repartition("dimension", "ordering", "block").sortWithinPartitions("dimension", "ordering", "block")
    found = rows.mapInArrow(_scored(nearest), "point long, id long, score double").groupBy("point", "id").agg(F.max("score").alias("score"))
    # A point has a few finds from each of its blocks.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))), 1, nearest + 1)
    merged = found.groupBy("point").agg(best.alias("best")).join(classes.select("point", "digest"), "point")
    answers = queries.join(merged.select("digest", "best"), "digest")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, nearest)
    flat = answers.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
