"""Rank fusion and reranking of two lists; `chunk_index` searches both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import overlap_share, tokenize
from quarrylens.operators.ranking import settle, top_k
from quarrylens.operators.sizing import fetch_by_key

# Fixed values -------------------------------------------------------------
RRF_K = 60
CANDIDATES = 25
FINAL_K = 5
# --------------------------------------------------------------------------

Scorer = Callable[[Column, Column], Column]


def lexical_coverage(query: Column, content: Column) -> Column:
    """Share of the distinct query terms found in the content.

    A reproducible stand-in for a cross-encoder, not equal to one.
    """
    return F.coalesce(overlap_share(tokenize(query), tokenize(content)), F.lit(0.0))


_SCORERS: dict[str, Scorer] = {"lexical": lexical_coverage}


def register_scorer(name: str, scorer: Scorer) -> None:
    """Add a scorer of (query, content) columns, such as a pandas UDF of a model."""
    _SCORERS[name] = scorer


def get_scorer(name: str = "lexical") -> Scorer:
    """The named scorer, or the local default for a name nobody registered."""
    return _SCORERS.get(name, lexical_coverage)


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = CANDIDATES, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists of (query_id, doc_id, rank).

    The lists are stacked and grouped on (query_id, doc_id): one exchange, and
    an id repeated in a list keeps its last rank.  Ties go to the dense list.
    """
    none = F.lit(None).cast("int")
    stacked = dense.select("query_id", "doc_id", F.col("rank").cast("int").alias("dense"), none.alias("sparse")).unionByName(
        sparse.select("query_id", "doc_id", none.alias("dense"), F.col("rank").cast("int").alias("sparse"))
    )
    merged = stacked.groupBy("query_id", "doc_id").agg(
        F.max("dense").alias("dense_rank"),
        F.max("sparse").alias("bm25_rank"),
        F.min("dense").alias("dense_first"),
        F.min("sparse").alias("bm25_first"),
    )
    share = lambda rank: F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    scored = merged.withColumn("rrf_score", share("dense_rank") + share("bm25_rank"))
    order = [F.desc("rrf_score"), F.asc_nulls_last("dense_first"), F.asc_nulls_last("bm25_first")]
    fused = top_k(scored, ["query_id"], order, k)
    return fused.select("query_id", "doc_id", "dense_rank", "bm25_rank", "rrf_score", "rank")


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    k: int = FINAL_K,
    scorer: str | Scorer = "lexical",
) -> DataFrame:
    """Re-score fused candidates and keep ``k``, ties in candidate order.

    ``queries`` has (query_id, query), ``docs`` (doc_id, content).  Contents
    are fetched for the candidates only, by a scan when these are few.
    """
    score = get_scorer(scorer) if isinstance(scorer, str) else scorer
    rows = fetch_by_key(candidates.withColumnRenamed("rank", "fused_rank").join(queries, "query_id"), docs, "doc_id")
    scored = rows.withColumn("rerank_score", score(F.col("query"), F.col("content")).cast("double"))
    best = top_k(scored, ["query_id"], [F.desc(settle(F.col("rerank_score"))), F.asc("fused_rank")], k)
    return best.drop("query")


def retrieved_projection(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Typed hit rows: metadata fetched late, defaults for what is missing."""
    columns = set(chunks.columns)
    meta = lambda name, kind: (F.col(f"c.{name}") if name in columns else F.lit(None)).cast(kind)
    own = [c for c in chunks.columns if c != "doc_id"]
    fetched = fetch_by_key(hits, chunks.select("doc_id", F.struct(*own).alias("c")), "doc_id", "left")
    joined = fetched.select("c", F.struct(*hits.columns).alias("h"))
    score = F.col("h.score") if "score" in hits.columns else F.lit(0.0)
    return joined.select(
        F.col("h.query_id").alias("query_id"),
        F.col("h.rank").alias("rank"),
        F.coalesce(meta("chunk_id", "string"), F.lit("")).alias("chunk_id"),
        F.coalesce(meta("content", "string"), F.lit("")).alias("content"),
        F.coalesce(F.col("h.rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double"), F.lit(0.0)).alias("rerank_score"),
        F.coalesce(F.col("h.rrf_score") if "rrf_score" in hits.columns else F.lit(None).cast("double"), score).alias("rrf_score"),
        (F.col("h.dense_rank") if "dense_rank" in hits.columns else F.lit(None).cast("int")).alias("dense_rank"),
        (F.col("h.bm25_rank") if "bm25_rank" in hits.columns else F.lit(None).cast("int")).alias("bm25_rank"),
        F.coalesce(F.col("h.doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce(meta("doc_type", "string"), F.lit("")).alias("doc_type"),
        F.coalesce(meta("page_number", "int"), F.lit(0)).alias("page_number"),
        meta("section_header", "string").alias("section_header"),
        meta("table_index", "int").alias("table_index"),
        F.coalesce(meta("content_type", "string"), F.lit("")).alias("content_type"),
        F.coalesce(meta("token_count", "int"), F.lit(0)).alias("token_count"),
    )
