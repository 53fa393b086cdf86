"""Whitening of embeddings by spectral divide and conquer.

1. Each entry c of a vector becomes the whole number x = floor(64 c) + 1000000.
   One aggregate gives the number of vectors and the exact sums of every dimension.
2. The covariance is summed in the tasks over x less the rounded means, so all
   products and sums are whole numbers, exact and alike for any partitioning; what
   the rounding left of the mean, at most a half, is taken off at the end.
3. The matrix, dimension by dimension whatever the number of rows, is split
   on the driver.  Shifted by a value inside its spectrum, its orthogonal polar factor has
   the eigenvalue 1 for what lies above the shift and -1 for what lies below;
   half of it plus the identity is the projector on the upper invariant subspace.
   The polar factor comes from QDWH, an iteration with dynamic weights and a few
   QR decompositions.  Both subspaces are split on until each is one component.
4. The components over the roots of their eigenvalues are broadcast, and every
   vector is projected where it is.  A last aggregate over the results
   measures how far their covariance is from the identity.

A vector that is null, empty or holds null or non-finite entries takes no part;
nor do vectors of another dimension than most (ties: the larger one).  Entries
beyond 2**46 saturate.  Rows that repeat an id or a vector count each.
Rows without id take part with a null id.  Components without variance have a
null ``whitened``, as there is nothing to scale; of a table without
variance ``explained`` is null too, and ``identity_error`` is null when no component has
variance.  ``deviation`` is null where it exceeds a long.  An empty table gives
no rows.  Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**46
# Components with less than this share of the largest eigenvalue have no variance.
LEAST_SHARE = 1e-13
# Further shifts that are tried when the first ones hit an eigenvalue.
SHIFTS = 30
# Vectors multiplied at once.
ROWS = 4096
_SEED = 20240611


def fit_list(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    finite = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))
    scaled = lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double"))) * SCALE).cast("long") + OFFSET
    whole = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))
    rows = whole.select(F.col("vec_id").cast("long"), F.transform("embedding", scaled).alias("x"))
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("x") == F.lit(widths["width"] if widths else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(column).slice(at, ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _products(rows: DataFrame, column: str, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the products and of the values of an array column less ``centre``, over all rows.

    A task sends one row for each pair of dimensions, added up by Spark.
    """
    width = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((width, width)), np.zeros(width)
        for values in _matrices(batches, 0):
            centred = (values - centre).astype(np.float64)
            products += centred.T @ centred
            sums += centred.sum(axis=0)
        for k in range(width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width + 1, k, np.int32)), pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(np.append(products[k], sums[k]))], ["i", "j", "value"]
            )

    parts = rows.select(column).mapInArrow(run, "i int, j int, value double")
    total = np.zeros((width, width + 1))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value
    return total[:, :width], total[:, width]


def polar(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH."""
    size = len(matrix)
    x = matrix / np.linalg.norm(matrix, "fro")
    # A bound of the least singular value; one that is too small costs a step at most.
    try:
        low = max(np.finfo(float).eps, 1.0 / np.linalg.norm(np.linalg.inv(x), "fro"))
    except np.linalg.LinAlgError:
        low = np.finfo(float).eps
    for _ in range(40):
        square = low * low
        d = np.cbrt(4.0 * (1.0 - square) / (square * square))
        a = np.sqrt(1.0 + d) + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * np.sqrt(1.0 + d)))
        b = (a - 1.0) ** 2 / 4.0
        c = a + b - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(size)]))
        fresh = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        change = np.linalg.norm(fresh - x, "fro")
        x = (fresh + fresh.T) / 2.0
        low = min(1.0, low * (a + b * square) / (1.0 + c * square))
        if change < np.cbrt(np.finfo(float).eps) and 1.0 - low < 1e-8:
            break
    return x


def _subspaces(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix whose first ``rank`` columns span the projector's image."""
    size = len(projector)
    drawn = projector @ rng.normal(size=(size, rank))
    upper, _ = np.linalg.qr(projector @ np.linalg.qr(drawn)[0])
    rest = rng.normal(size=(size, size - rank))
    for _ in range(2):
        rest, _ = np.linalg.qr(rest - upper @ (upper.T @ rest))
    return np.hstack([upper, rest])


def spectral_split(matrix: np.ndarray, floor: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal components of a symmetric matrix, by halves of its spectrum.

    A part whose entries differ from a multiple of the identity by no more than
    ``floor`` has one eigenvalue, and any basis is one of components.
    """
    size = len(matrix)
    middle = np.trace(matrix) / size
    if size == 1 or np.linalg.norm(matrix - middle * np.eye(size), "fro") <= floor:
        return np.eye(size)
    # Some eigenvalues lie on either side of their mean; a shift that is one of them projects nothing.
    spread = np.linalg.norm(matrix - middle * np.eye(size), "fro") / np.sqrt(size)
    for shift in (float(np.median(np.diag(matrix))), middle, *(middle + spread * rng.uniform(-1.0, 1.0, size=SHIFTS))):
        projector = (polar(matrix - shift * np.eye(size)) + np.eye(size)) / 2.0
        rank = int(round(np.trace(projector)))
        if 0 < rank < size and np.linalg.norm(projector @ projector - projector, "fro") < 1e-9:
            break
    else:
        raise ArithmeticError("no shift splits the spectrum")
    basis = _subspaces(projector, rank, rng)
    turned = basis.T @ matrix @ basis
    turned = (turned + turned.T) / 2.0
    above = basis[:, :rank] @ spectral_split(turned[:rank, :rank], floor, rng)
    below = basis[:, rank:] @ spectral_split(turned[rank:, rank:], floor, rng)
    return np.hstack([above, below])


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit components as columns; the largest entry of each is positive."""
    size = len(covariance)
    scale = np.linalg.norm(covariance, "fro")
    if scale == 0.0:
        return np.zeros(size), np.eye(size)
    rng = np.random.default_rng(_SEED)
    vectors = spectral_split(covariance, 4 * size * np.finfo(float).eps * scale, rng)
    # What the splits dropped is rounding noise; one more split-free turn removes most of it.
    vectors = _polished(covariance, vectors)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return np.maximum(values[order], 0.0), vectors * signs


def _polished(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One step of first-order correction of all components."""
    turned = vectors.T @ matrix @ vectors
    values = np.diag(turned)
    gaps = values[None, :] - values[:, None]
    # Components as close as the noise itself keep their place.
    safe = np.abs(gaps) > 1e3 * np.abs(turned)
    step = np.where(safe, turned / np.where(safe, gaps, 1.0), 0.0)
    fixed, upper = np.linalg.qr(vectors @ (np.eye(len(matrix)) + step - np.diag(np.diag(step))))
    return fixed * np.sign(np.diag(upper))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = fit_list(vectors)
    exact = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()
    if not exact:
        return spark.createDataFrame([], schema)
    n, sums = exact[0]["n"], [int(r["s"]) for r in exact]
    # Rounded means, and what is left of each mean.
    whole = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    centre = np.array(whole, dtype=np.int64)
    products, _ = _products(rows, "x", centre)
    covariance = products / n - np.outer(rest, rest)
    values, axes = components_of((covariance + covariance.T) / 2.0)
    count = min(components, len(values))
    has_variance = values[:count] > LEAST_SHARE * max(float(values[0]), np.finfo(float).tiny)
    scaled = axes[:, :count] / np.where(has_variance, np.sqrt(np.where(has_variance, values[:count], 1.0)), np.nan)
    trace = float(np.trace(covariance))
    shares = values[:count] / trace if trace > 0 else np.full(count, np.nan)
    shipped = spark.sparkContext.broadcast((centre, rest, scaled, [s - w * n for s, w in zip(sums, whole)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, rest, scaled, remainders = shipped.value
        for batch in batches:
            at = 0
            for x in _matrices(iter([batch]), 1):
                whitened = ((x - centre) - rest) @ scaled
                flat = pa.array(whitened.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * scaled.shape[1]), flat)
                ids = batch.column(0).slice(at, len(x))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_deviations(x - centre, n, remainders), pa.int64()), lists], ["vec_id", "deviation", "z"])
                at += len(x)

    projected = rows.mapInArrow(run, "vec_id long, deviation long, z array<double>")
    kept = np.flatnonzero(has_variance)
    error = None
    if len(kept):
        present = projected.select(F.array(*[F.get("z", F.lit(int(k))) for k in kept]).alias("z"))
        squares, totals = _products(present, "z", np.zeros(len(kept)))
        means = totals / n
        error = float(np.abs(squares / n - np.outer(means, means) - np.eye(len(kept))).max())
    number = lambda v: F.lit(None).cast("double") if v is None or np.isnan(v) else F.lit(float(v))
    explained = F.array(*[number(v) for v in shares])
    exploded = projected.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return exploded.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), number(error).alias("identity_error"),
    )


def _deviations(less: np.ndarray, n: int, remainders: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 as whole numbers, x - rounded mean being given; null beyond a long.

    n x - S is n times ``less`` minus the remainder of the mean, so it stays small.
    """
    largest = float(np.abs(less).max(initial=0)) * n + max(map(abs, remainders), default=0)
    if largest * largest * less.shape[1] < 2.0**62:
        apart = less.astype(np.int64) * n - np.array(remainders, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    sums = [sum((v * n - r) ** 2 for v, r in zip(row, remainders)) for row in less.tolist()]
    return [s if s < 1 << 63 else None for s in sums]
