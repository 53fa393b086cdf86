"""Queries over the sparse and dense index and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.text import tokenize
from quarrylens.operators import fusion
from quarrylens.operators.chunk_index import DIMENSIONS, ChunkIndex
from quarrylens.operators.dense import dense_topk as dense_search
from quarrylens.operators.dense import dense_topk_by_id as dense_search_by_id
from quarrylens.operators.dense import l2_normalize, vector_norm
from quarrylens.operators.sparse_index import SparseIndex, postings
from quarrylens.plans.catalog import documents, long, query, r6, sql_share, sql_token_count, sql_tokens, table
from quarrylens.plans.text_queries import SQL_CHUNKS, plain_chunk_rows
from quarrylens.sources.tables import upsert_latest

def sql_corpus(source: str) -> str:
    """Tokens, postings and weights of a table with doc_id, lang and text."""
    return f"""
toks AS MATERIALIZED (SELECT doc_id, lang, {sql_tokens('text')} toks FROM {source}),
dl AS (SELECT doc_id, lang, len(toks) dl FROM toks),
post AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(toks) term FROM toks) GROUP BY ALL),
st AS (SELECT count(*) n, sum(dl)::DOUBLE / count(*) avgdl FROM dl),
tdf AS (SELECT term, count(*) df FROM post GROUP BY term),
raw AS (SELECT term, df, ln((SELECT n FROM st) - df + 0.5) - ln(df + 0.5) r FROM tdf),
mi AS (SELECT avg(r) m FROM raw),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT m FROM mi) ELSE r END idf FROM raw)"""


SQL_CORPUS = sql_corpus("documents")


def sql_bm25(k: int = 25, where: str = "true", corpus: str = SQL_CORPUS) -> str:
    return f"""{corpus},
qt AS (SELECT query_id, term, count(*) qtf FROM (SELECT item_id query_id, unnest({sql_tokens('text')}) term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, sum(qtf * idf * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) s
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st WHERE {where} GROUP BY ALL),
sparse AS (
  SELECT query_id, doc_id, round(s, 9) score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank
  FROM scored WHERE s > 0 QUALIFY rank <= {k})"""


def sql_dense(k: int = 25, where: str = "true") -> str:
    return f"""
dense AS (
  SELECT q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v WHERE {where} QUALIFY rank <= {k})"""


# Chunks as the corpus; their type takes the place of the language.
SQL_CHUNK_CORPUS = f"""
corpus AS MATERIALIZED (SELECT doc_id || '::' || block_index || '::' || chunk_index doc_id, t lang, p AS text FROM chunks), {sql_corpus('corpus')}"""

SQL_TERM_SLOTS = f"""
slots AS MATERIALIZED (
  SELECT term, idf * CASE WHEN ('0x' || substr(md5(term), 5, 1))::INT < 8 THEN 1 ELSE -1 END w, ('0x' || substr(md5(term), 1, 4))::INT % {DIMENSIONS} slot FROM idf),
qsum AS (SELECT query_id, slot, sum(qtf * w) v FROM qt JOIN slots USING (term) GROUP BY ALL)"""


def sql_chunk_dense(k: int = 25, where: str = "true") -> str:
    """Hashed term vectors of queries and chunks and their cosines."""
    return f"""{SQL_TERM_SLOTS},
qunit AS MATERIALIZED (SELECT query_id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) v FROM qsum),
dsum AS (SELECT doc_id, slot, sum(tf * w) v FROM post JOIN slots USING (term) GROUP BY ALL),
dunit AS MATERIALIZED (SELECT doc_id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) v FROM dsum JOIN dl USING (doc_id) WHERE {where}),
near AS (SELECT query_id, doc_id, round(sum(q.v * d.v), 9) score FROM qunit q JOIN dunit d USING (slot) GROUP BY ALL),
dense AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= {k})"""


def sql_fused(where: str = "true") -> str:
    """Both legs over the chunks that ``where`` selects, fused."""
    return f"""{SQL_CHUNKS}, {sql_bm25(where=where, corpus=SQL_CHUNK_CORPUS)}, {sql_chunk_dense(where=where)},
fused AS (
  SELECT query_id, doc_id, d.rank dense_rank, s.rank bm25_rank,
    coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) rrf_score
  FROM dense d FULL JOIN sparse s USING (query_id, doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) AS rank
  FROM fused QUALIFY rank <= 25)"""


SQL_FUSED = sql_fused()


def sql_reranked(source: str) -> str:
    return f"""
covered AS (
  SELECT r.*, coalesce({sql_share('q.t', 'd.toks')}, 0) rerank_score
  FROM {source} r JOIN (SELECT item_id query_id, {sql_tokens('text')} t FROM benchmark) q USING (query_id) JOIN toks d USING (doc_id)),
reranked AS (
  SELECT * EXCLUDE (rank, place), place AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank) AS place FROM covered)
  WHERE place <= 5)"""


_ENGLISH = "lang = 'en'"
_PROSE = "lang = 'prose'"

# The stored index of each data folder that a session has searched: state of the folder, path.
_STORED: dict[tuple[str, str], tuple[tuple, str]] = {}


def chunk_index(spark: SparkSession, root: str) -> ChunkIndex:
    """The index over the chunks of all documents, built once and opened again while the files are the same."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    files = table(spark, root, "documents").select(F.xxhash64(*meta).alias("file")).distinct()
    state = tuple(files.agg(F.count("*"), F.sum(F.col("file").cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, root)
    if _STORED.get(key, (None,))[0] != state:
        built = ChunkIndex.build(plain_chunk_rows(spark, root), "chunk_id", "content", keep=["doc_id", "content_type"], wide=True)
        _STORED[key] = (state, built.path)
        return built
    return ChunkIndex.open(spark, _STORED[key][1])


def build_index(spark: SparkSession, root: str) -> SparseIndex:
    return SparseIndex.build(documents(spark, root), "doc_id", "text")


def bm25_hits(spark: SparkSession, root: str, k: int = 25) -> DataFrame:
    return build_index(spark, root).search(table(spark, root, "benchmark"), "item_id", "text", k)


def query_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The vector of every benchmark item: the collection row of its id."""
    items = table(spark, root, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, root, "embeddings").join(items, "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")


@query(
    "bm25_postings",
    f"WITH {SQL_CORPUS} SELECT doc_id, term, tf::BIGINT tf, dl::BIGINT dl FROM post JOIN dl USING (doc_id)",
)
def bm25_postings(spark: SparkSession, root: str) -> DataFrame:
    rows = postings(documents(spark, root), "doc_id", tokenize(F.col("text")))
    return rows.select("doc_id", "term", "tf", long("dl").alias("dl"))


@query(
    "bm25_corpus_stats",
    f"WITH {SQL_CORPUS} SELECT n::BIGINT n_docs, round(avgdl, 6) avgdl, (SELECT count(*) FROM tdf) n_terms, round(m, 6) mean_idf FROM st, mi",
)
def bm25_corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    stats = build_index(spark, root).stats()
    return stats.select("n_docs", r6("avgdl").alias("avgdl"), "n_terms", r6("mean_idf").alias("mean_idf"))


@query("bm25_idf", f"WITH {SQL_CORPUS} SELECT term, df::BIGINT df, round(idf, 6) idf FROM idf")
def bm25_idf(spark: SparkSession, root: str) -> DataFrame:
    return build_index(spark, root).idf().select("term", "df", r6("idf").alias("idf"))


@query("bm25_topk", f"WITH {sql_bm25()} SELECT query_id, rank, doc_id, round(score, 6) score FROM sparse")
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    return bm25_hits(spark, root).select("query_id", long("rank").alias("rank"), "doc_id", r6("score").alias("score"))


@query("bm25_topk_filtered", f"WITH {sql_bm25(where=_ENGLISH)} SELECT query_id, rank, doc_id, round(score, 6) score FROM sparse")
def bm25_topk_filtered(spark: SparkSession, root: str) -> DataFrame:
    hits = build_index(spark, root).search(
        table(spark, root, "benchmark"), "item_id", "text", where=F.col("lang") == "en"
    )
    return hits.select("query_id", long("rank").alias("rank"), "doc_id", r6("score").alias("score"))


@query("index_roundtrip", f"WITH {sql_bm25()} SELECT query_id, rank, doc_id, round(score, 6) score FROM sparse")
def index_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Write an index of documents, open it again, search the stored postings."""
    built = ChunkIndex.build(documents(spark, root), "doc_id", "text", dense=False, wide=True)
    opened = ChunkIndex.open(spark, built.path)
    hits = opened.named(opened.sparse_topk(table(spark, root, "benchmark"), "item_id", "text"))
    return hits.select("query_id", long("rank").alias("rank"), "doc_id", r6("score").alias("score"))


@query(
    "index_upsert",
    f"""WITH corpus AS (
      SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'rewritten ' || lang || ' text of ' || source ELSE text END AS text
      FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1 OR toxic = 1
      UNION ALL SELECT item_id + 1000000000, 'en', text FROM benchmark),
    {sql_bm25(corpus=sql_corpus('corpus'))} SELECT query_id, rank, doc_id, round(score, 6) score FROM sparse""",
)
def index_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Toxic documents replaced, benchmark texts inserted, other bad ones deleted: searched as an index built anew."""
    docs, labels = documents(spark, root).select("doc_id", "lang", "source", "text"), table(spark, root, "labels")
    items = table(spark, root, "benchmark")
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    rewritten = toxic.select("doc_id", F.concat_ws(" ", F.lit("rewritten"), "lang", F.lit("text of"), "source").alias("text"))
    fresh = rewritten.unionByName(items.select((F.col("item_id") + 1_000_000_000).alias("doc_id"), "text"))
    index = ChunkIndex.build(docs, "doc_id", "text", dense=False, wide=True).upsert(fresh, "text")
    index = index.delete(labels.filter("quality = 0 AND toxic = 0").select("doc_id"))
    hits = index.named(index.sparse_topk(items, "item_id", "text"))
    return hits.select("query_id", long("rank").alias("rank"), "doc_id", r6("score").alias("score"))


@query(
    "chunk_bm25_topk",
    f"{SQL_CHUNKS}, {sql_bm25(corpus=SQL_CHUNK_CORPUS)} SELECT query_id, rank, doc_id chunk_id, score FROM sparse",
)
def chunk_bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    index = chunk_index(spark, root)
    return _chunk_hits(index, index.sparse_topk(table(spark, root, "benchmark"), "item_id", "text"))


@query(
    "chunk_dense_topk",
    f"{SQL_CHUNKS}, {sql_bm25(corpus=SQL_CHUNK_CORPUS)}, {sql_chunk_dense()} SELECT query_id, rank, doc_id chunk_id, score FROM dense",
)
def chunk_dense_topk(spark: SparkSession, root: str) -> DataFrame:
    index = chunk_index(spark, root)
    return _chunk_hits(index, index.dense_topk(table(spark, root, "benchmark"), "item_id", "text"))


def _chunk_hits(index: ChunkIndex, hits: DataFrame) -> DataFrame:
    return index.named(hits).select("query_id", long("rank").alias("rank"), "chunk_id", "score")


@query(
    "embed_texts",
    f"{SQL_CHUNKS}, {sql_bm25(corpus=SQL_CHUNK_CORPUS)}, {SQL_TERM_SLOTS} SELECT query_id, slot::BIGINT slot, round(v, 6) + 0 AS value FROM qsum WHERE round(v, 6) <> 0",
)
def embed_texts(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the query texts' vectors that are not zero."""
    vectors = chunk_index(spark, root).query_vectors(table(spark, root, "benchmark"), "item_id", "text")
    cells = vectors.select("query_id", F.posexplode("embedding").alias("slot", "value"))
    return cells.select("query_id", long("slot").alias("slot"), r6("value").alias("value")).filter("value != 0")


@query("dense_topk", f"WITH {sql_dense()} SELECT query_id, rank, vec_id, round(score, 6) score FROM dense")
def dense_topk(spark: SparkSession, root: str) -> DataFrame:
    hits = dense_search(table(spark, root, "embeddings"), query_vectors(spark, root))
    return hits.select("query_id", long("rank").alias("rank"), "vec_id", r6("score").alias("score"))


@query(
    "dense_topk_by_id",
    """WITH named AS (SELECT 'vec-' || vec_id AS vec_id, embedding FROM embeddings WHERE label = 1),
    near AS (
      SELECT 'item-' || q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) score
      FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, named v)
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near QUALIFY rank <= 10""",
)
def dense_topk_by_id(spark: SparkSession, root: str) -> DataFrame:
    """Text ids on both sides, and a filter before the limit."""
    vectors = table(spark, root, "embeddings").withColumn("vec_id", F.concat(F.lit("vec-"), "vec_id"))
    asked = query_vectors(spark, root).withColumn("query_id", F.concat(F.lit("item-"), "query_id"))
    hits = dense_search_by_id(vectors, asked, 10, F.col("label") == 1)
    return hits.select("query_id", "vec_id", "score", long("rank").alias("rank"))


@query(
    "dense_topk_filtered",
    f"WITH {sql_dense(where='v.label = 1')} SELECT query_id, rank, vec_id, round(score, 6) score FROM dense",
)
def dense_topk_filtered(spark: SparkSession, root: str) -> DataFrame:
    hits = dense_search(table(spark, root, "embeddings"), query_vectors(spark, root), where=F.col("label") == 1)
    return hits.select("query_id", long("rank").alias("rank"), "vec_id", r6("score").alias("score"))


@query(
    "embed_normalize",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) norm,
      round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) first_value,
      round(list_max(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) largest, 1.0::DOUBLE unit_norm FROM embeddings""",
)
def embed_normalize(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select("vec_id", vector_norm(F.col("embedding")).alias("norm"), l2_normalize(F.col("embedding")).alias("u"))
    return rows.select(
        "vec_id", r6("norm").alias("norm"), r6(F.col("u")[0]).alias("first_value"), r6(F.array_max("u")).alias("largest"),
        r6(vector_norm(F.col("u"))).alias("unit_norm"),
    )


@query("rrf_fuse", f"{SQL_FUSED} SELECT query_id, rank, doc_id chunk_id, dense_rank, bm25_rank, round(rrf_score, 6) rrf_score FROM ranked")
def rrf_fuse(spark: SparkSession, root: str) -> DataFrame:
    index = chunk_index(spark, root)
    fused = index.fused(table(spark, root, "benchmark"), "item_id", "text").withColumnRenamed("doc_id", "doc_no")
    return index.named(fused).select(
        "query_id", long("rank").alias("rank"), "chunk_id", long("dense_rank").alias("dense_rank"),
        long("bm25_rank").alias("bm25_rank"), r6("rrf_score").alias("rrf_score"),
    )


@query(
    "rerank_lexical",
    f"WITH {sql_bm25()}, {sql_reranked('sparse')} SELECT query_id, rank, doc_id, round(rerank_score, 6) rerank_score FROM reranked",
)
def rerank_lexical(spark: SparkSession, root: str) -> DataFrame:
    asked = table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = documents(spark, root).select("doc_id", F.col("text").alias("content"))
    best = fusion.rerank(bm25_hits(spark, root).select("query_id", "doc_id", "rank"), asked, docs)
    return best.select("query_id", long("rank").alias("rank"), "doc_id", r6("rerank_score").alias("rerank_score"))


def hybrid_hits(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    return chunk_index(spark, root).hybrid(table(spark, root, "benchmark"), "item_id", "text", where=where)


_SQL_HYBRID_COLUMNS = "query_id, rank, doc_id chunk_id, dense_rank, bm25_rank, round(rrf_score, 6) rrf_score, round(rerank_score, 6) rerank_score"


@query("hybrid_search", f"{SQL_FUSED}, {sql_reranked('ranked')} SELECT {_SQL_HYBRID_COLUMNS} FROM reranked")
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk of every document, on both legs."""
    return _hybrid_rows(hybrid_hits(spark, root))


@query("hybrid_search_filtered", f"{sql_fused(_PROSE)}, {sql_reranked('ranked')} SELECT {_SQL_HYBRID_COLUMNS} FROM reranked")
def hybrid_search_filtered(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of running text only, on both legs."""
    return _hybrid_rows(hybrid_hits(spark, root, F.col("content_type") == "prose"))


def _hybrid_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", long("rank").alias("rank"), "chunk_id", long("dense_rank").alias("dense_rank"),
        long("bm25_rank").alias("bm25_rank"), r6("rrf_score").alias("rrf_score"), r6("rerank_score").alias("rerank_score"),
    )


@query(
    "retrieved_projection",
    f"""WITH {sql_bm25(5)}
    SELECT query_id, rank, doc_id::VARCHAR || '::0::0' chunk_id, doc_id::VARCHAR doc_id, 0.0::DOUBLE rerank_score, round(score, 6) rrf_score,
      '' doc_type, 0::BIGINT page_number, source section_header, lang content_type, {sql_token_count('text')}::BIGINT token_count, length(text)::BIGINT n_chars
    FROM sparse JOIN documents USING (doc_id)""",
)
def retrieved_projection(spark: SparkSession, root: str) -> DataFrame:
    rows = fusion.retrieved_projection(bm25_hits(spark, root, 5), chunk_view(spark, root))
    return rows.select(
        "query_id", long("rank").alias("rank"), "chunk_id", "doc_id", "rerank_score", r6("rrf_score").alias("rrf_score"), "doc_type",
        long("page_number").alias("page_number"), "section_header", "content_type", long("token_count").alias("token_count"),
        long(F.length("content")).alias("n_chars"),
    )


def chunk_view(spark: SparkSession, root: str) -> DataFrame:
    """Documents as chunks: one chunk each, source as section, language as type."""
    return documents(spark, root).select(
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit("::0::0")).alias("chunk_id"),
        F.col("text").alias("content"),
        F.col("source").alias("section_header"),
        F.col("lang").alias("content_type"),
        (F.floor(F.length("text") / 4) + 1).alias("token_count"),
    )


@query(
    "upsert_latest",
    """WITH v AS (SELECT doc_id, 1 AS version, md5(text) digest FROM documents
      UNION ALL SELECT doc_id, 2 + quality + toxic, md5(text || '!') FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, max(version)::BIGINT AS version, max_by(digest, version) digest FROM v GROUP BY doc_id""",
)
def upsert(spark: SparkSession, root: str) -> DataFrame:
    """Stored documents met by a batch that holds every labelled one again."""
    docs = documents(spark, root)
    stored = docs.select("doc_id", F.lit(1).alias("version"), F.md5(F.encode("text", "UTF-8")).alias("digest"))
    fresh = docs.join(table(spark, root, "labels"), "doc_id").select(
        "doc_id", (F.lit(2) + F.col("quality") + F.col("toxic")).alias("version"),
        F.md5(F.encode(F.concat("text", F.lit("!")), "UTF-8")).alias("digest"),
    )
    return upsert_latest(stored, fresh, "doc_id", "version").select("doc_id", long("version").alias("version"), "digest")


@query("corpus_count", "SELECT count(*) n_chunks, true AS is_built FROM documents")
def corpus_count(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).agg(F.count("*").alias("n_chunks")).withColumn("is_built", F.col("n_chunks") > 0)
