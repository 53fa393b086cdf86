"""Sparse and dense search, fusion and rerank on small fixtures."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from quarrylens.functions.text import tokenize
from quarrylens.operators import dense, fusion, sizing, sparse_index
from quarrylens.operators.sparse_index import SparseIndex, postings
from quarrylens.sources.tables import create_collection, upsert_latest

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = [(0, "red apple red"), (1, "green apple pie"), (2, "blue sky"), (3, "")]
QUERIES = [(10, "red red pie"), (11, "!!"), (12, "unseen words")]


def bm25(docs, query, k1=1.5, b=0.75):
    """Scores of one query, straight from the formula."""
    texts = {i: t.split() for i, t in docs}
    n, avgdl = len(texts), sum(map(len, texts.values())) / len(texts)
    terms = {t for ts in texts.values() for t in ts}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t in terms for d in [sum(t in ts for ts in texts.values())]}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    return {
        i: sum(idf.get(q, 0) * ts.count(q) * (k1 + 1) / (ts.count(q) + k1 * (1 - b + b * len(ts) / avgdl)) for q in query.split() if q in ts)
        for i, ts in texts.items()
    }


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return SparseIndex.build(docs, "doc_id", "text")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid long, q string")


def test_bm25_by_hand(index, queries):
    hits = {(r.query_id, r.doc_id): r.score for r in index.search(queries, "qid", "q").collect()}
    expected = {(10, i): s for i, s in bm25(DOCS, "red red pie").items() if s > 0}
    assert hits.keys() == expected.keys()
    assert all(abs(hits[key] - expected[key]) < 1e-8 for key in hits)
    assert len(index) == 4 and index.n_terms == 6


def test_bm25_shuffled_query_side_is_the_same(index, queries, monkeypatch):
    whole = sorted(map(tuple, index.search(queries, "qid", "q").collect()))
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(sizing.settle_small_side, "__defaults__", (1,))
    assert sorted(map(tuple, index.search(queries, "qid", "q").collect())) == whole


def test_bm25_filter_keeps_global_statistics(index, queries):
    every = {(r.query_id, r.doc_id): r.score for r in index.search(queries, "qid", "q").collect()}
    some = index.search(queries, "qid", "q", where=F.col("doc_id") == 1).collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in some] == [(10, 1, 1)]
    assert some[0].score == every[10, 1]


def test_stored_postings_give_the_same_hits(spark, index, queries, tmp_path):
    path = str(tmp_path / "postings")
    postings(index.docs, "doc_id", tokenize(F.col("text"))).write.parquet(path)
    stored = index.search_postings(spark.read.parquet(path), queries, "qid", "q")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, index.search(queries, "qid", "q").collect()))


def test_bm25_moves_no_posting_when_weights_are_few(index, queries):
    plan = index.search(queries, "qid", "q")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan and "hashpartitioning(doc_id" not in plan


SHOWN = (
    "bm25_topk context_block context_budget context_precision extractive_answer format_chunk lexical_faithfulness lexical_recall "
    "prompt_messages rerank_lexical retrieved_projection span_outputs telemetry_rows"
).split()


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables absent")
@pytest.mark.parametrize("name", SHOWN)
def test_no_pair_of_document_and_query_is_held_for_shown_hits(spark, monkeypatch, name):
    def refuse(*args):
        raise AssertionError("pairs of documents and queries are grouped")

    monkeypatch.setattr(sparse_index, "_rank", refuse)
    assert contract.queries()[name](spark, ROOT).collect()


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_bm25_slices_keep_the_best_of_all(monkeypatch, cells):
    import random

    import pyarrow as pa

    rng = random.Random(4)
    draw = lambda n: [f"w{min(29, int(rng.expovariate(0.2)))}" for _ in range(n)]
    docs = [(f"d{k:03d}", draw(rng.randrange(0, 30))) for k in range(150)]
    docs += [(f"c{k:03d}", docs[7][1]) for k in range(20)]
    asked = {q: {t: rng.uniform(-1, 3) for t in set(draw(6)) | {"absent"}} for q in ("qa", "qb", "qc")}
    norm = lambda dl: 0.3 + dl / 20

    monkeypatch.setattr(sparse_index, "CELLS", cells)
    rows = [(t, q, w) for q, terms in asked.items() for t, w in terms.items()]
    weights = sparse_index._Weights.of(pa.table(dict(zip(("term", "query_id", "weight"), map(list, zip(*rows))))))
    best = None
    for start in range(0, len(docs), 64):
        ids, tokens = zip(*docs[start : start + 64])
        best = weights.best_of(pa.record_batch({"doc_id": list(ids), "tokens": list(tokens)}), norm, 9, best)
    want = []
    for q, terms in asked.items():
        scores = {i: sum(w * ts.count(t) / (ts.count(t) + norm(len(ts))) for t, w in terms.items()) for i, ts in docs}
        hits = sorted((-round(s, 9), i) for i, s in scores.items() if s > 0)[:9]
        want += [(q, i, -s) for s, i in hits]
    got = sorted(zip(*(best.column(c).to_pylist() for c in ("query_id", "doc_id", "score"))), key=lambda r: (r[0], -r[2], r[1]))
    assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in want]
    np.testing.assert_allclose([s for *_, s in got], [s for *_, s in want], atol=2e-9)


def test_tiny_corpus_has_no_positive_score(spark, queries):
    docs = spark.createDataFrame([(0, "red")], "doc_id long, text string")
    assert SparseIndex.build(docs, "doc_id", "text").search(queries, "qid", "q").collect() == []


def test_empty_corpus_and_missing_index_raise(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        SparseIndex.build(docs, "doc_id", "text")
    with pytest.raises(Exception):
        SparseIndex.load(spark, docs, "doc_id", "text", str(tmp_path / "absent"))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    data[100:200] = data[7]  # a third of all rows are copies
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def exact(data, ids, queries, k):
    data = data.astype(np.float32).astype(np.float64)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    out = []
    for q in queries:
        scores = np.round(unit @ unit[q], 9)
        best = sorted(ids, key=lambda i: (-scores[i], i))[:k]
        out += [(q, i, round(float(scores[i]), 6), rank) for rank, i in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("budget, block", [(1 << 20, 1000), (1, 37), (1, 100000)])
def test_dense_topk_both_ways(vectors, budget, block):
    data, df = vectors
    asked = df.filter("vec_id in (0, 7, 150, 299)").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = dense.dense_topk(df, asked, 25, broadcast_bytes=budget, block_rows=block).collect()
    ours = sorted((r.query_id, r.vec_id, round(r.score, 6), r["rank"]) for r in hits)
    assert ours == exact(data, range(300), [0, 7, 150, 299], 25)


def test_dense_filter_before_limit(vectors):
    data, df = vectors
    asked = df.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = dense.dense_topk(df, asked, 10, where=F.col("label") == 2).collect()
    assert sorted((r.query_id, r.vec_id, round(r.score, 6), r["rank"]) for r in hits) == exact(data, range(2, 300, 3), [7], 10)


def test_dense_without_queries(vectors):
    _, df = vectors
    none = df.filter("false").select(F.col("vec_id").alias("query_id"), "embedding")
    assert dense.dense_topk(df, none).collect() == []


def test_normalize_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r.u for r in df.select(dense.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_rrf_ties_and_repeats(spark):
    ddl = "query_id int, doc_id int, rank int"
    left = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 6, 4)], ddl)
    right = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], ddl)
    rows = fusion.rrf_fuse(left, right).orderBy("rank").collect()
    # 5 and 7 tie at rank one: the dense list goes first.  6 keeps its last rank.
    assert [(r.doc_id, r.dense_rank, r.bm25_rank) for r in rows] == [(5, 1, None), (7, None, 1), (8, None, 2), (6, 4, None)]
    assert rows[0].rrf_score == 1 / 61


def test_rerank_is_stable_and_pluggable(spark):
    candidates = spark.createDataFrame([(1, i, i + 1) for i in range(8)], "query_id int, doc_id int, rank int")
    docs = spark.createDataFrame([(i, "red" if i < 6 else "red pie") for i in range(8)], "doc_id int, content string")
    asked = spark.createDataFrame([(1, "red pie")], "query_id int, query string")
    best = fusion.rerank(candidates, asked, docs).orderBy("rank").collect()
    assert [r.doc_id for r in best] == [6, 7, 0, 1, 2]
    fusion.register_scorer("length", lambda query, content: F.length(content))
    assert fusion.get_scorer("nobody") is fusion.lexical_coverage
    assert fusion.rerank(candidates, asked, docs, 1, "length").first().doc_id == 6
    assert fusion.rerank(candidates.filter("false"), asked, docs).collect() == []


def test_projection_defaults(spark):
    hits = spark.createDataFrame([(1, 4, 1, 0.5), (1, 9, 2, 0.25)], "query_id int, doc_id int, rank int, score double")
    chunks = spark.createDataFrame([(4, "c", "text")], "doc_id int, chunk_id string, content string")
    rows = fusion.retrieved_projection(hits, chunks).orderBy("rank").collect()
    assert (rows[0].content, rows[0].rrf_score, rows[0].page_number) == ("text", 0.5, 0)
    assert (rows[1].chunk_id, rows[1].content, rows[1].section_header) == ("", "", None)


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], "id int, v int, x string")
    assert sorted(map(tuple, upsert_latest(old, new, "id", "v").collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 2, "d")]


def test_collection_is_kept_unless_recreated(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS vectors_db LOCATION '{tmp_path}/db'")
    name = "vectors_db.chunks"
    assert create_collection(spark, name, "id long, embedding array<float>")
    assert not create_collection(spark, name, "id long, embedding array<float>")
    assert create_collection(spark, name, "id long", recreate=True)
    assert spark.table(name).columns == ["id"]
    spark.sql("DROP DATABASE vectors_db CASCADE")
