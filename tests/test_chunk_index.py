"""The stored chunk index: pruning, vectors, segments, ids of any type, legs at once."""

import os
import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import chunk_index, sizing
from quarrylens.operators.chunk_index import ChunkIndex, at_once, hashed_vectors
from quarrylens.operators.dense import dense_topk_by_id
from quarrylens.operators.numbering import numbered
from quarrylens.operators.sparse_index import SparseIndex
from quarrylens.session import shared_dir

WORDS = [f"w{k}" for k in range(300)]
DDL = "chunk_id string, content string, kind string"


def chunk_rows(seed, n, prefix="d"):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [WORDS[min(299, int(rng.expovariate(0.03)))] for _ in range(rng.randrange(4, 60))]
        out.append((f"{prefix}{k:04d}::0::{k % 3}", " ".join(words), "prose" if k % 4 else "table"))
    return out


ASKED = [("q-a", "w3 w40 w90 w3"), ("q-b", "w120 w121"), ("q-c", "unseen"), ("q-d", "")]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(ASKED, "qid string, q string")


def sparse_rows(index, queries, **options):
    hits = index.named(index.sparse_topk(queries, "qid", "q", 10, **options))
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in hits.collect())


def rebuilt(spark, rows, queries):
    index = SparseIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content")
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in index.search(queries, "qid", "q", 10).collect())


@pytest.fixture(scope="module")
def built(spark):
    rows = chunk_rows(1, 600)
    return rows, ChunkIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content", keep=["kind"], span=16)


def test_stored_search_equals_the_plain_index(spark, built, queries):
    rows, index = built
    assert sparse_rows(index, queries) == rebuilt(spark, rows, queries)
    assert sparse_rows(ChunkIndex.open(spark, index.path), queries) == rebuilt(spark, rows, queries)


def test_many_weights_meet_in_a_shuffle(built, queries, monkeypatch):
    _, index = built
    want = sparse_rows(index, queries)
    only = sparse_rows(index, queries, where=F.col("kind") == "table")
    monkeypatch.setattr(sizing.settle_small_side, "__defaults__", (1,))
    assert sparse_rows(index, queries) == want
    assert sparse_rows(index, queries, where=F.col("kind") == "table") == only


def test_filter_before_the_limit_keeps_statistics(built, queries):
    rows, index = built
    kinds = {i: kind for i, _, kind in rows}
    hits = index.named(index.sparse_topk(queries, "qid", "q", 1000)).collect()
    scores = {(r.query_id, r.chunk_id): r.score for r in hits}
    some = index.named(index.sparse_topk(queries, "qid", "q", 5, where=F.col("kind") == "table"), ["kind"]).collect()
    assert some and all(r.kind == "table" and abs(scores[r.query_id, r.chunk_id] - r.score) < 1e-9 for r in some)
    for query in {q for q, _ in scores}:
        best = sorted((-s, i) for (q, i), s in scores.items() if q == query and kinds[i] == "table")[:5]
        assert [i for _, i in best] == [r.chunk_id for r in sorted(some, key=lambda r: r["rank"]) if r.query_id == query]


def test_blocks_that_cannot_reach_a_hit_are_skipped(spark, queries):
    # Two spans repeat the asked words; all others mention one of them once.
    rows = [(f"a{k:04d}", "w3 w40 w90 w3 w120 w121" if k < 40 else f"w3 w{200 + k % 50} " * 3 + "filler " * 30, "prose") for k in range(1600)]
    index = ChunkIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content", span=16)
    report = {}
    hits = index.sparse_topk(queries.filter("qid = 'q-a'"), "qid", "q", 5, report=report).count()
    assert hits == 5 and report["bounded"] == 100 and report["scored"] < 10


def test_a_search_opens_the_folders_of_its_terms(spark, built, queries):
    _, index = built
    report = {}
    index.sparse_topk(queries.filter("qid = 'q-b'"), "qid", "q", 5, report=report).count()
    assert report["folders"] <= 2 < index.parts


def test_blocks_hold_one_span_of_one_term(spark, built):
    rows, index = built
    blocks = spark.read.parquet(f"{index.path}/segments/{index.segments[0]}/blocks").collect()
    counts = Counter()
    for b in blocks:
        assert list(b.places) == sorted(set(b.places)) and len(b.places) <= 16 and max(b.places) < 16
        counts[b.term] += len(b.places)
        pairs = list(zip(b.tfs, b.dls))
        front = {(t, d) for t, d in pairs if not any((t2 >= t and d2 < d) or (t2 > t and d2 <= d) for t2, d2 in pairs)}
        assert {tuple(i) for i in b.impacts} == front
    assert counts == Counter(t for _, text, _ in rows for t in set(text.split()))


def test_segments_equal_a_rebuild(spark, built, queries):
    rows, _ = built
    index = ChunkIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content", keep=["kind"], span=16)
    now = {r[0]: r for r in rows}
    changed = [(i, text + " w40 w40", kind) for i, text, kind in rows[10:60]] + chunk_rows(9, 30, "new")
    later = index.upsert(spark.createDataFrame(changed, DDL))
    now |= {r[0]: r for r in changed}
    dropped = [rows[k][0] for k in range(0, 300, 7)] + ["never there"]
    later = later.delete(spark.createDataFrame([(i,) for i in dropped], "chunk_id string"))
    for i in dropped:
        now.pop(i, None)
    again = [(i, "w120 w121 w122", "table") for i in list(now)[5:8]] + [(dropped[0], "w3 w3 back again", "prose")]
    later = later.upsert(spark.createDataFrame(again, DDL))
    now |= {r[0]: r for r in again}
    opened = ChunkIndex.open(spark, index.path)
    assert opened.version == later.version == 3 and opened.segments[:1] == index.segments and len(opened.segments) == 4
    rows_now = sorted(now.values())
    assert len(opened) == len(rows_now)
    assert sorted((r.chunk_id, r.content) for r in opened.docs().collect()) == [(i, t) for i, t, _ in rows_now]
    plain = SparseIndex.build(spark.createDataFrame(rows_now, DDL), "chunk_id", "content")
    assert (opened.n_terms, round(opened.mean_idf, 9)) == (plain.n_terms, round(plain.mean_idf, 9))
    assert sparse_rows(opened, queries) == rebuilt(spark, rows_now, queries)
    packed = opened.compact()
    assert len(packed.segments) == 1 and sparse_rows(packed, queries) == rebuilt(spark, rows_now, queries)
    # The first version can still be read, and a second writer of a version is refused.
    assert sparse_rows(index, queries) == rebuilt(spark, rows, queries)
    with pytest.raises(Exception):
        index.delete(spark.createDataFrame([(rows[0][0],)], "chunk_id string"))


def test_wrong_input_raises(spark, tmp_path):
    twice = spark.createDataFrame([("a", "x", ""), ("a", "y", "")], DDL)
    with pytest.raises(ValueError):
        ChunkIndex.build(twice, "chunk_id", "content")
    with pytest.raises(ValueError):
        ChunkIndex.build(twice.limit(0), "chunk_id", "content")
    with pytest.raises(Exception):
        ChunkIndex.open(spark, str(tmp_path / "absent"))


def brute_vector(counts, idf):
    import hashlib

    out = np.zeros(chunk_index.DIMENSIONS)
    for term, n in counts.items():
        digest = hashlib.md5(term.encode()).hexdigest()
        out[int(digest[:4], 16) % chunk_index.DIMENSIONS] += (1 if int(digest[4], 16) < 8 else -1) * n * idf.get(term, 0.0)
    return out


def test_every_text_has_its_vector(spark, built, queries):
    rows, index = built
    plain = SparseIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content")
    idf = {r.term: r.idf for r in plain.idf().collect()}
    texts = dict((i, t) for i, t, _ in rows)
    vectors = {r.chunk_id: np.array(r.embedding) for r in index.named(index.vectors()).collect()}
    assert vectors.keys() == texts.keys()
    for i, v in vectors.items():
        np.testing.assert_allclose(v, brute_vector(Counter(texts[i].split()), idf), atol=1e-9)
    asked = {r.query_id: np.array(r.embedding) for r in index.query_vectors(queries, "qid", "q").collect()}
    assert asked.keys() == {"q-a", "q-b"}
    hits = index.named(index.dense_topk(queries, "qid", "q", 7)).collect()
    for query, vector in asked.items():
        near = {i: round(float(v @ vector / np.linalg.norm(v) / np.linalg.norm(vector)), 9) for i, v in vectors.items()}
        best = sorted(near, key=lambda i: (-near[i], i))[:7]
        assert [r.chunk_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == query] == best


def test_hybrid_hits_have_ids_and_columns(built, queries):
    _, index = built
    hits = index.hybrid(queries, "qid", "q", where=F.col("kind") == "prose").collect()
    assert {r.query_id for r in hits} == {"q-a", "q-b"} and all(r.kind == "prose" and r["rank"] <= 5 for r in hits)
    assert any(r.dense_rank is not None and r.bm25_rank is not None for r in hits)


def test_legs_run_at_once(spark):
    spans, lock = [], threading.Lock()

    def leg():
        start = time.time()
        slow = spark.range(0, 2, 1, 2).mapInPandas(lambda batches: (b for b in batches if time.sleep(1.0) is None), "id long")
        assert slow.count() == 2
        with lock:
            spans.append((start, time.time()))
        return spark.range(1)

    first, second = at_once(spark, leg, leg)
    assert first.count() == second.count() == 1
    assert max(a for a, _ in spans) < min(b for _, b in spans)


def test_numbers_follow_the_ids(spark):
    ids = [f"id-{k:05d}" for k in range(500)]
    df = spark.createDataFrame([(i,) for i in random.Random(2).sample(ids, 500)], "id string").repartition(7)
    assert sorted((r.no, r.id) for r in numbered(df, "id", "no", 40).collect()) == [(40 + k, i) for k, i in enumerate(ids)]


@pytest.mark.parametrize("budget", [1 << 20, 1])
def test_dense_search_by_any_id(spark, budget):
    rng = np.random.default_rng(5)
    data = np.vstack([rng.normal(size=(60, 6)), np.repeat(rng.normal(size=(1, 6)), 20, axis=0)]).astype(np.float32)
    names = [f"v{k:03d}::{k % 7}::0" for k in range(80)]
    df = spark.createDataFrame([(i, [float(x) for x in v], k % 2) for k, (i, v) in enumerate(zip(names, data))], "vec_id string, embedding array<float>, label int").repartition(4)
    asked = df.filter(F.col("vec_id").isin(names[3], names[70])).select(F.concat(F.lit("q/"), "vec_id").alias("query_id"), "embedding")
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    for where, allowed in ((None, range(80)), (F.col("label") == 1, range(1, 80, 2))):
        hits = dense_topk_by_id(df, asked, 9, where, broadcast_bytes=budget)
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in hits.collect())
        want = []
        for q in (3, 70):
            near = np.round(unit @ unit[q], 9)
            best = sorted(allowed, key=lambda k: (-near[k], names[k]))[:9]
            want += [(f"q/{names[q]}", r, names[k]) for r, k in enumerate(best, 1)]
        assert got == sorted(want)


def test_chunks_are_made_once_and_postings_are_no_table(spark, queries):
    made = spark.sparkContext.accumulator(0)
    before = set(os.listdir(shared_dir(spark)))

    def make(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = chunk_rows(3, 400)
    chunks = spark.createDataFrame(rows, DDL).mapInPandas(make, DDL)
    index = ChunkIndex.build(chunks, "chunk_id", "content", span=32)
    assert made.value == len(rows)
    assert not [n for n in set(os.listdir(shared_dir(spark))) - before if n.startswith("postings")]
    assert sparse_rows(index, queries) == rebuilt(spark, rows, queries)


@pytest.mark.parametrize("most", [0, 7, 60])
def test_vectors_do_not_depend_on_the_terms_that_are_shipped(spark, built, monkeypatch, most):
    rows, index = built
    want = {r.chunk_id: r.embedding for r in index.named(index.vectors()).collect()}
    monkeypatch.setattr(chunk_index, "FREQUENT_TERMS", most)
    again = ChunkIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content", span=64)
    assert again.terms().filter(F.col("df") >= again.base["frequent"]).count() <= most
    got = {r.chunk_id: r.embedding for r in again.named(again.vectors()).collect()}
    assert got.keys() == want.keys()
    for i in want:
        np.testing.assert_allclose(got[i], want[i], atol=1e-9)


def test_texts_without_words_and_spans_by_size(spark, queries):
    rows = [("a", "", "x"), ("b", None, "x"), ("c", "w3 w3 w40", "x"), ("d", " ,. ", "x"), ("e", "other", "x"), ("f", "words", "x"), ("g", "here", "x")]
    index = ChunkIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content", span=2)
    assert [r.chunk_id for r in index.named(index.vectors()).orderBy("chunk_id").collect()] == ["c", "e", "f", "g"]
    assert {(r[0], r[2]) for r in sparse_rows(index, queries)} == {("q-a", "c")}
    assert [chunk_index.span_for(*c) for c in ((7, 90), (200_000, 9_000_000), (10**7, 5 * 10**8), (10**6, 10**9))] == [1024, 2048, 4096, 1024]


def test_vectors_of_no_counts(spark):
    none = spark.createDataFrame([], "doc_no long, term string, tf long")
    assert hashed_vectors(none, "doc_no", F.col("tf")).collect() == []


def test_an_index_of_postings_alone_makes_no_vectors(spark, built, queries):
    rows, both = built
    index = ChunkIndex.build(spark.createDataFrame(rows, DDL), "chunk_id", "content", keep=["kind"], span=16, dense=False)
    later = index.upsert(spark.createDataFrame([("new", "w3 w40 w120", "prose")], DDL))
    opened = ChunkIndex.open(spark, index.path)
    assert not any("vectors" in os.listdir(f"{index.path}/segments/{name}") for name in opened.segments)
    assert sparse_rows(index, queries) == sparse_rows(both, queries)
    assert sparse_rows(opened, queries) == rebuilt(spark, [*rows, ("new", "w3 w40 w120", "prose")], queries)
    for version in (index, later, opened):
        with pytest.raises(ValueError):
            version.dense_topk(queries, "qid", "q")


def test_counts_and_vectors_follow_from_blocks_alone(spark, built):
    rows, index = built
    assert "dl" not in index.docs().columns
    assert index.n_tokens == sum(len(text.split()) for _, text, _ in rows)
    blocks = spark.read.parquet(f"{index.path}/segments/{index.segments[0]}/blocks")
    assert all((b["df"], b.tokens) == (len(b.places), sum(b.tfs)) for b in blocks.collect())
    want = {r.doc_no: r.embedding for r in index.vectors().collect()}
    got = {r.doc_no: r.embedding for r in index._vectors_of(blocks).collect()}
    assert got.keys() == want.keys()
    for no in want:
        np.testing.assert_allclose(got[no], want[no], atol=1e-9)


def test_only_blocks_of_asked_terms_reach_the_scoring(spark, built, queries, monkeypatch):
    rows, index = built
    plain, asked = chunk_index.span_hits, {w for _, text in ASKED for w in text.split()}

    def watched(block, *others):
        strange = set(block.column("term").to_pylist()) - asked
        if strange:
            raise ValueError(f"moved {len(strange)} terms that nobody asked for")
        return plain(block, *others)

    monkeypatch.setattr(chunk_index, "span_hits", watched)
    assert sparse_rows(index, queries) == rebuilt(spark, rows, queries)


def test_best_of_a_span_by_brute_force():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS[:12]) for _ in range(rng.choice([3, 3, 7]))) for _ in range(64)]
    block = chunk_index.span_blocks(pa.table({"doc_no": list(range(64, 128)), "text": texts}), 64)
    weights = {"a": (["w1", "w2", "none"], [1.5, 0.25, 9.0]), "b": (["w1", "w5"], [2.0, -1.0])}
    norm = lambda dl: 0.5 + dl / 10
    only = [n for n in range(64) if n % 3]
    want = {}
    for query, (terms, given) in weights.items():
        for n, text in enumerate(texts):
            words = text.split()
            raw = sum(w * words.count(t) / (words.count(t) + norm(len(words))) for t, w in zip(terms, given))
            if raw > 0:
                want.setdefault(query, []).append((-round(raw, 9), n + 64))
    for limited in (False, True):
        for k in (1, 5, 100):
            for floors in ((None, None), (0.4, 0.9), (0.0, 99.0)):
                rows = [("a", floors[0], None), ("b", floors[1], None)] + [(None, None, only)] * limited
                asks = pa.table({"query_id": [r[0] for r in rows], "floor": pa.array([r[1] for r in rows], pa.float64()), "only": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})
                found = chunk_index.span_hits(block, asks, weights, 64, norm, limited, k).to_pylist()
                for query, floor in zip("ab", floors):
                    best = sorted(h for h in want[query] if (not limited or (h[1] - 64) % 3) and -h[0] >= (floor or 0))[:k]
                    assert [(-round(r["score"], 9), r["doc_no"]) for r in found if r["query_id"] == query] == best


def test_a_wide_index_has_fewer_blocks_and_the_same_hits(spark, queries, monkeypatch):
    monkeypatch.setattr(chunk_index, "LEAST_SPAN", 4)
    monkeypatch.setattr(chunk_index.span_for, "__defaults__", (4, 1 << 20))
    rows = spark.createDataFrame(chunk_rows(5, 600), DDL)
    narrow, wide = (ChunkIndex.build(rows, "chunk_id", "content", dense=False, wide=w) for w in (False, True))
    assert (narrow.span, wide.span) == (4, 8)
    assert wide._table("blocks").count() < narrow._table("blocks").count()
    assert sparse_rows(wide, queries) == sparse_rows(narrow, queries)
    assert ChunkIndex.open(spark, wide.path).upsert(spark.createDataFrame([("new", "w3", "prose")], DDL)).span == 8


def test_wide_spans_by_size():
    wide = lambda *size: chunk_index.span_for(*size, chunk_index.WIDE_SPAN, chunk_index.TOKENS_A_WIDE_SPAN)
    assert [wide(*c) for c in ((7, 90), (200_000, 9_000_000), (10**7, 5 * 10**8), (10**6, 10**9), (3 * 10**6, 15 * 10**8))] == [1024, 2048, 16384, 4096, 8192]
