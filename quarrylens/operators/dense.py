"""Exact cosine top-k over batches of query vectors.

Vector pairs are never materialised: a task multiplies a batch of vectors with
the query matrix and keeps the best k per query, so it emits k rows per query
however many vectors it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.numbering import numbered
from quarrylens.operators.ranking import SCORE_DECIMALS, top_k
from quarrylens.operators.sizing import fetch_by_key

# Fixed values -------------------------------------------------------------
DEFAULT_TOP_K = 25
ENCODE_BATCH = 32
# --------------------------------------------------------------------------

# Scores held at once, and queries of one tile.
TILE_BYTES, TILE_SIDE = 32 << 20, 4096
# Largest query matrix sent to every task.
BROADCAST_BYTES = 64 << 20
# Rows per side of a block when the queries exceed that.
BLOCK_ROWS = 16384

_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_HITS_DDL = "query_id long, vec_id long, score double"


def l2_normalize(vector: Column) -> Column:
    """Vector scaled to length one, in double; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def vector_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda total, x: total + x * x))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best per row of ``scores``; ties by id."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        query, at = np.nonzero(scores >= floor[:, None])
    else:
        query, at = np.nonzero(np.isfinite(scores))
    value, vec = scores[query, at], ids[at]
    return _cut(query, vec, value, k)


def _best_of_product(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of every query over all vectors, in tiles of at most ``TILE_BYTES`` of scores."""
    rows = min(len(queries), TILE_SIDE)
    columns = max(1, TILE_BYTES // (8 * max(1, rows)))
    out = []
    for q in range(0, len(queries), rows):
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        for v in range(0, len(vectors), columns):
            scores = np.round(queries[q : q + rows] @ vectors[v : v + columns].T, SCORE_DECIMALS)
            fresh = _best(scores, ids[v : v + columns], k)
            held = _cut(*(np.concatenate(pair) for pair in zip(held, fresh)), k)
        out.append((held[0] + q, held[1], held[2]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _cut(query: np.ndarray, vec: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -value, query))
    query, vec, value = query[order], vec[order], value[order]
    starts = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - starts < k
    return query[keep], vec[keep], value[keep]


def _table(query_ids: np.ndarray, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    query, vec, value = hits
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[query], pa.int64()), pa.array(vec, pa.int64()), pa.array(value, pa.float64())], schema=_HITS
    )


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    where: Column | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best ``k`` vectors of every query: query_id, vec_id, score, rank.

    ``vectors`` has (vec_id long, embedding), ``queries`` (query_id long,
    embedding).  ``where`` filters vectors before the limit.  A query matrix
    within ``broadcast_bytes`` is shipped to the scan and no vector moves;
    a larger one is met block by block through a shuffle.
    """
    if where is not None:
        vectors = vectors.filter(where)
    vectors = vectors.select("vec_id", "embedding")
    queries = queries.select("query_id", "embedding")
    probe = queries.select(F.size("embedding").alias("dim")).limit(1).collect()
    if not probe:
        return vectors.sparkSession.createDataFrame([], _HITS_DDL + ", rank int")
    bound = max(1, broadcast_bytes // (8 * max(1, probe[0]["dim"])))
    bounded = queries.limit(bound + 1).toArrow()
    if bounded.num_rows <= bound:
        partial = _against_broadcast(vectors, bounded, k)
    else:
        partial = _by_blocks(vectors, queries, k, block_rows)
    return top_k(partial, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def dense_topk_by_id(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, where: Column | None = None, **bounds: int) -> DataFrame:
    """As :func:`dense_topk`, for ids of any ordered type on either side.

    Ids are numbered in their order, the numbers are searched, and ids are
    joined back for the hits alone.  Ids are unique.
    """
    kept = (vectors if where is None else vectors.filter(where)).select("vec_id", "embedding")
    rows = numbered(kept, "vec_id", "vec_no")
    asked = numbered(queries.select("query_id", "embedding"), "query_id", "query_no")
    searched = asked.select(F.col("query_no").alias("query_id"), "embedding")
    hits = dense_topk(rows.select(F.col("vec_no").alias("vec_id"), "embedding"), searched, k, **bounds)
    hits = hits.select(F.col("query_id").alias("query_no"), F.col("vec_id").alias("vec_no"), "score", "rank")
    found = fetch_by_key(hits, rows.select("vec_no", "vec_id"), "vec_no")
    return fetch_by_key(found, asked.select("query_no", "query_id"), "query_no").select("query_id", "vec_id", "score", "rank")


def _against_broadcast(vectors: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    ids = queries.column("query_id").to_numpy()
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, _matrix(queries.column("embedding"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shipped.value
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fresh = _best_of_product(matrix, _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy(), k)
            held = _cut(*(np.concatenate(pair) for pair in zip(held, fresh)), k)
        if len(held[0]):
            yield _table(query_ids, held)

    return vectors.mapInArrow(scan, _HITS_DDL)


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Meet query blocks and vector blocks pairwise, each pair in one task.

    Ids are unique, so hashing them fills blocks evenly and their number is
    set from the row counts; a task holds one block of each side.
    """
    query_blocks = math.ceil(queries.count() / block_rows)
    vector_blocks = max(1, math.ceil(vectors.count() / block_rows))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(
        "query_id", F.col("embedding").alias("embedding"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"),
        numbers(vector_blocks).alias("vb"),
    )
    right = vectors.select(
        "vec_id", F.col("embedding").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(vector_blocks)).cast("int").alias("vb"),
        numbers(query_blocks).alias("qb"),
    )

    def meet(query_block: pa.Table, vector_block: pa.Table) -> pa.Table:
        if not query_block.num_rows or not vector_block.num_rows:
            return _HITS.empty_table()
        hits = _best_of_product(
            _matrix(query_block.column("embedding")), _matrix(vector_block.column("embedding")), vector_block.column("vec_id").to_numpy(), k
        )
        return pa.Table.from_batches([_table(query_block.column("query_id").to_numpy(), hits)])

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, _HITS_DDL)
