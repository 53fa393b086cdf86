"""Percentiles, running figures, snapshots, routing and traces."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import percentiles as P
from quarrylens.operators import sketches as SK
from quarrylens.operators import telemetry as T
from quarrylens.operators.blocks import number_blocks

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("values", [[5.0], [1.0, 9.0], [20.0, 100.0, 200.0, 350.0, 900.0], [float(i * i % 97) for i in range(100)]])
def test_three_percentiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    n, ordered = len(values), sorted(values)
    exclusive = P.percentile_exclusive(df, ["g"], "v", [50, 95]).first()
    for p in (50, 95):
        expected = statistics.quantiles(values, n=100)[p - 1] if n > 1 else values[0]
        assert abs(exclusive[f"p{p}"] - expected) < 1e-9
        assert P.percentile_floor(df, ["g"], "v", [p]).first()[f"p{p}"] == ordered[max(1, n * p // 100) - 1]
        assert P.percentile_ceil(df, ["g"], "v", [p]).first()[f"p{p}"] == ordered[max(1, -(-n * p // 100)) - 1]


def test_large_groups_are_bracketed_exactly(spark, monkeypatch):
    # A sketch coarser than its grid misses ranks, so that both sides of the tried ends are taken.
    monkeypatch.setattr(P, "SKETCH_ACCURACY", 200)
    monkeypatch.setattr(P, "GRID", 150)
    monkeypatch.setattr(P, "FEW", 40)
    rng = random.Random(1)
    skewed = [rng.expovariate(0.01) for _ in range(60_000)] + [7.0] * 30_000
    rng.shuffle(skewed)
    rows = [("hot", v) for v in skewed] + [("cold", float(v)) for v in range(50)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = {r.g: r for r in P.percentile_exclusive(df, ["g"], "v", [1, 50, 95, 99]).collect()}
    for g, values in (("hot", skewed), ("cold", [float(v) for v in range(50)])):
        cuts = statistics.quantiles(values, n=100)
        assert all(abs(found[g][f"p{p}"] - cuts[p - 1]) < 1e-7 for p in (1, 50, 95, 99))
    whole = P.percentile_floor(df, [], "v", [50]).first()
    assert whole.p50 == sorted(skewed + [float(v) for v in range(50)])[(90_050 * 50) // 100 - 1] and whole.n == 90_050


def test_few_values_are_left_to_sort(spark, monkeypatch):
    # A continuous column: every value differs.
    monkeypatch.setattr(P, "FEW", 300)
    sorted_at_last, rounds = [], []
    kept, counted = P._kept, P._counted
    monkeypatch.setattr(P, "_kept", lambda ends: sorted_at_last.append(kept(ends)) or sorted_at_last[-1])
    monkeypatch.setattr(P, "_counted", lambda *a: rounds.append(1) or counted(*a))
    df = spark.range(200_000).select(F.exp(F.pmod(F.col("id") * 7919, F.lit(200_003)) / 10_000).alias("v"))
    found = P.percentile_floor(df, [], "v", [50, 99]).first()
    ordered = sorted(r.v for r in df.collect())
    assert (found.p50, found.p99) == (ordered[100_000 - 1], ordered[198_000 - 1])
    ends = sorted_at_last[-1].first()["__ends"]
    assert len(rounds) <= 2 and all(e["value"] is not None or e["inside"] <= 300 for e in ends)


def test_values_at_ranks_of_nothing(spark):
    none = spark.createDataFrame([("g", None)], "g string, v double")
    assert P.percentile_exclusive(none, ["g"], "v", [50]).collect() == []
    assert P.percentile_floor(none, [], "v", [50]).first() in (None, (0, None))


def test_running_figures_cross_buckets(spark):
    rows = [("d", i, kind, f"t{i}") for i, kind in ((1, "prose"), (2, "heading"), (65536, "table"), (65537, "prose"), (200000, "table"), (200001, "heading"))]
    rows += [("e", 9, "table", "x")]
    df = spark.createDataFrame(rows, "doc string, pos long, kind string, text string")
    out = number_blocks(df, "doc", "pos", "kind", "text").orderBy("doc", "pos").collect()
    assert [r.block_index for r in out] == [0, 1, 2, 3, 4, 5, 0]
    assert [r.table_index for r in out] == [None, None, 0, None, 1, None, 0]
    assert [r.section_header for r in out] == [None, "t2", "t2", "t2", "t2", "t200001", None]


LOG = "query_id int, ts timestamp_ntz, user string, query string, category string, total_latency_ms double, confidence double, is_decline boolean, num_citations int"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, T0 + dt.timedelta(hours=9 * i), "u" if i % 3 else "v", "q" * 90, "ab"[i % 2], 50.5 + 100 * i, 0.5, i == 4, i) for i in range(8)]
    return spark.createDataFrame(rows, LOG)


def test_last_n(log):
    newest = [F.desc("ts")]
    assert sorted(r.query_id for r in T.last_n(log, newest, 3).collect()) == [5, 6, 7]
    assert T.last_n(log, newest, 0).count() == 8 and T.last_n(log, newest, None).count() == 8


def test_live_snapshot(log):
    s = T.live_snapshot(log, [F.desc("ts")], 5).first()
    assert (s.total_queries, s.answered, s.declined, s.avg_confidence) == (5, 4, 1, 0.5)
    assert (s.p50, s.p95) == (450, 650) and list(s.latency_buckets) == [0, 0, 0, 2, 3]
    assert [c.name for c in s.categories] == ["a", "b"] and len(s.recent[0].query) == 80 and s.recent[0].citations == 7
    empty = T.live_snapshot(log.filter("false"), [F.desc("ts")]).first()
    assert (empty.total_queries, empty.p50, list(empty.latency_buckets), empty.categories, empty.recent) == (0, 0, [0] * 5, [], [])


def test_session_stats(log):
    out = {r.query_id: r for r in T.session_stats(log, "user", "ts").collect()}
    assert [(out[i].queries, out[i].answered, out[i].declined) for i in (1, 2, 4, 5, 7)] == [(1, 1, 0), (2, 2, 0), (3, 2, 1), (4, 3, 1), (5, 4, 1)]
    assert abs(out[4].avg_latency - statistics.mean([150.5, 250.5, 450.5])) < 1e-9 and out[4].avg_session_confidence == 0.5


def test_histogram_keeps_empty_buckets(log):
    rows = T.latency_histogram(log.filter("total_latency_ms > 600"), "total_latency_ms").orderBy("bucket").collect()
    assert [r.n for r in rows] == [0, 0, 0, 0, 2] and rows[4].label == ">500ms"


def test_routing_priority(spark):
    texts = ["Return my PAYMENT", "payment of commission", "cart", "rto", "GST variant", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    got = df.select("i", T.keyword_route(F.col("q")).alias("k")).withColumn("c", T.route_category(F.col("k"))).orderBy("i").collect()
    assert [(r.k, r.c) for r in got] == [("return", "returns"), ("commission", "commission"), (None, "other"), ("rto", "rto"), ("gst", "onboarding"), (None, "other")]
    served = T.served_answers(df, "i", "q").orderBy("query_id").collect()
    assert len(served) == 5 and all(0.85 <= r.confidence <= 0.95 for r in served if not r.is_decline)


def test_spans(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0, 4.0, None), ("f", 1.0, 2.0, 4.0, "generation")], "trace_id string, retrieval_latency_ms double, generation_latency_ms double, citation_validation_latency_ms double, failed_at string")
    spans = T.query_spans(df)
    assert [(r.span, r.start_ms, r.status) for r in spans.filter("trace_id = 'f'").orderBy("position").collect()] == [("retrieval", 0.0, "ok"), ("generation", 1.0, "error")]
    parents = {r.trace_id: (r.n_spans, r.end_ms, r.has_error) for r in T.span_rollup(spans).collect()}
    assert parents == {"t": (3, 7.0, 0), "f": (2, 3.0, 1)}


def test_traced_steps(spark):
    sink = []
    assert T.traced("retrieval", sink, "t")(lambda x: x + 1)(1) == 2
    with pytest.raises(KeyError):
        T.traced("generation", sink, "t")(lambda: {}["x"])()
    assert T.traced("retrieval", None)(lambda: 3)() == 3
    parent = T.span_rollup(spark.createDataFrame(sink)).first()
    assert (parent.n_spans, parent.has_error) == (2, 1) and parent.end_ms >= parent.start_ms


def test_telemetry_defaults(spark):
    responses = spark.createDataFrame(
        [(1, "q" * 200, "t", 9.0, 1.0, 5, 6, 0.7, False, 2), (2, "x", None, None, None, None, None, None, None, None)],
        "query_id int, query string, trace_id string, total_latency_ms double, generation_latency_ms double, input_tokens int, output_tokens int, confidence double, is_decline boolean, num_citations int",
    )
    chunks = spark.createDataFrame([(1, 2, 0.1, "prose", 3.0), (1, 1, 0.9, "table", 4.0)], "query_id int, rank int, rerank_score double, content_type string, retrieval_latency_ms double")
    rows = {r.query_id: r for r in T.telemetry_rows(responses, chunks).collect()}
    assert (len(rows[1].query), rows[1].top_content_type, rows[1].top_rerank_score, rows[1].retrieval_latency_ms, rows[1].num_chunks_retrieved) == (100, "table", 0.9, 4.0, 2)
    assert (rows[2].is_decline, rows[2].top_content_type, rows[2].confidence, rows[2].num_chunks_retrieved) == (True, "unknown", 0.0, 0)


def test_tiers_and_report(spark):
    df = spark.createDataFrame([(0.85, False), (0.7, True), (0.69, False), (0.9, False)], "s double, d boolean")
    rows = df.select(T.score_tier(F.col("s")).alias("s"), T.confidence_tier(F.col("s"), F.col("d")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("good", "medium"), ("fair", "none"), ("poor", "low"), ("good", "high")]
    assert "p50" in T.report_text({"p50": 1.0})


def test_stored_sketches_answer_any_period(spark):
    rng = random.Random(8)
    rows = [(T0 + dt.timedelta(minutes=rng.randrange(60 * 24)), rng.choice("aab"), rng.lognormvariate(4, 1)) for _ in range(20_000)]
    odd = [(T0, "a", None), (T0, "a", float("nan")), (T0, "empty", None), (T0, None, 5.0)]
    df = spark.createDataFrame(rows + odd, "ts timestamp, k string, v double")
    first, late = df.filter("v < 60 or v is null"), df.filter("v >= 60")
    # Two batches of the same hours: their sketches stand side by side and are merged when read.
    stored = SK.hourly_sketches(first, "ts", ["k"], ["v"]).unionByName(SK.hourly_sketches(late, "ts", ["k"], ["v"])).cache()
    for since, until in ((None, None), (T0 + dt.timedelta(hours=6), T0 + dt.timedelta(hours=13))):
        merged = SK.merged_sketches(stored, ["k"], ["v"], since, until)
        got = merged.select(
            "k", SK.count(F.col("v")).alias("n"), SK.share_upto(F.col("v"), 60.0).alias("share"), *[SK.percentile(F.col("v"), p).alias(f"p{p}") for p in (5, 50, 95, 99)]
        )
        found = {r.k: r for r in got.collect()}
        for k in "ab":
            values = sorted(v for t, key, v in rows if key == k and (since is None or since <= t < until))
            assert found[k].n == len(values)
            for p in (5, 50, 95, 99):
                rank = sum(v <= found[k][f"p{p}"] for v in values) / len(values)
                assert abs(rank - p / 100) <= SK.RANK_ERROR + 1 / len(values)
            assert abs(found[k].share - sum(v <= 60 for v in values) / len(values)) <= SK.RANK_ERROR
        if since is None:
            assert found["empty"].n == 0 and found["empty"].p50 is None and found["empty"].share is None
            assert found[None].n == 1 and found[None].p50 == 5.0
    none = SK.merged_sketches(SK.hourly_sketches(df.limit(0), "ts", ["k"], ["v"]), ["k"], ["v"])
    assert none.count() == 0
