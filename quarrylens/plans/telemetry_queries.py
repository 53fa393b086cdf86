"""Queries over the query log.

``events`` stands in for the log: one event is one query, its value the total
latency in milliseconds, its type the category, an error a decline.  Derived
figures are scaled by powers of two, so both engines hold the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import percentiles as P
from quarrylens.operators import sketches as SK
from quarrylens.operators import telemetry as T
from quarrylens.operators.numbering import settled
from quarrylens.operators.sizing import fetch_by_key
from quarrylens.plans.catalog import documents, long, query, r6, table
from quarrylens.plans.retrieval_queries import bm25_hits, chunk_view, sql_bm25


def newest() -> list[Column]:
    return [F.desc("ts"), F.desc("query_id")]


def query_log(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").select(
        F.col("event_id").alias("query_id"),
        "ts",
        "user_id",
        F.col("props").alias("query"),
        F.col("event_type").alias("category"),
        F.col("value").alias("total_latency_ms"),
        (F.col("value") / 4).alias("retrieval_latency_ms"),
        (F.col("value") / 2).alias("generation_latency_ms"),
        (k * 20).alias("input_tokens"),
        (k * 3).alias("output_tokens"),
        (k / 128.0).alias("confidence"),
        (F.col("event_type") == "error").alias("is_decline"),
        F.floor(k / 32).alias("num_citations"),
        F.lit(5).alias("num_chunks"),
    )


SQL_LOG = """log AS (
  SELECT event_id query_id, ts, user_id, props query, event_type category, value total_latency_ms, value / 4 retrieval_latency_ms,
    value / 2 generation_latency_ms, k * 20 input_tokens, k * 3 output_tokens, k / 128.0::DOUBLE confidence, event_type = 'error' is_decline,
    k // 32 num_citations, 5 num_chunks
  FROM (SELECT *, (props->>'$.k')::INT k FROM events))"""
SQL_COST = "(input_tokens * 0.15e-6::DOUBLE + output_tokens * 0.60e-6::DOUBLE)"


def sql_exclusive(values: str, p: int) -> str:
    """Exclusive percentile of a sorted list."""
    n, m = f"len({values})", f"({p} * (len({values}) + 1))"
    j = f"least(greatest({m} // 100, 1), {n} - 1)"
    return f"(CASE WHEN {n} = 1 THEN {values}[1] ELSE ({values}[{j}] * (100 - ({m} - 100 * {j})) + {values}[{j} + 1] * ({m} - 100 * {j})) / 100 END)"


def sql_floor_rank(values: str, p: int) -> str:
    return f"{values}[greatest(1, len({values}) * {p} // 100)]"


_BY_TYPE = "WITH g AS (SELECT event_type, list_sort(list(value)) v FROM events GROUP BY event_type)"


@query("percentile_exclusive", f"{_BY_TYPE} SELECT event_type, len(v)::BIGINT n, round({sql_exclusive('v', 50)}, 6) p50, round({sql_exclusive('v', 95)}, 6) p95 FROM g")
def percentile_exclusive(spark: SparkSession, root: str) -> DataFrame:
    out = P.percentile_exclusive(table(spark, root, "events"), ["event_type"], "value", [50, 95])
    return out.select("event_type", "n", r6("p50").alias("p50"), r6("p95").alias("p95"))


@query("percentile_floor", f"{_BY_TYPE} SELECT event_type, len(v)::BIGINT n, {sql_floor_rank('v', 50)} p50, {sql_floor_rank('v', 95)} p95 FROM g")
def percentile_floor(spark: SparkSession, root: str) -> DataFrame:
    return P.percentile_floor(table(spark, root, "events"), ["event_type"], "value", [50, 95])


@query(
    "percentile_ceil",
    f"{_BY_TYPE} SELECT event_type, len(v)::BIGINT n, v[greatest(1, (len(v) * 50 + 99) // 100)] p50, v[greatest(1, (len(v) * 95 + 99) // 100)] p95 FROM g",
)
def percentile_ceil(spark: SparkSession, root: str) -> DataFrame:
    return P.percentile_ceil(table(spark, root, "events"), ["event_type"], "value", [50, 95])


@query("query_cost", f"WITH {SQL_LOG} SELECT query_id, round({SQL_COST} * 1000000, 6) cost_micro_usd FROM log")
def query_cost(spark: SparkSession, root: str) -> DataFrame:
    cost = T.query_cost(F.col("input_tokens"), F.col("output_tokens"))
    return query_log(spark, root).select("query_id", r6(cost * 1000000).alias("cost_micro_usd"))


@query("last_n_window", f"WITH {SQL_LOG} SELECT query_id, category, total_latency_ms FROM log ORDER BY ts DESC, query_id DESC LIMIT 1000")
def last_n_window(spark: SparkSession, root: str) -> DataFrame:
    return T.last_n(query_log(spark, root), newest()).select("query_id", "category", "total_latency_ms")


_SNAPSHOT_PERCENTILES = ", ".join(
    f"round({sql_exclusive(f'list_sort(list({k}_latency_ms))', p)}, 6) p{p}_{k}_latency_ms" for k in ("total", "retrieval", "generation") for p in (50, 95)
)
_SQL_SNAPSHOT = f"""count(*) sample_size, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') window_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') window_end, {_SNAPSHOT_PERCENTILES},
  round(sum({SQL_COST}) * 1000, 6) total_cost_milli_usd, round(avg({SQL_COST}) * 1000000, 6) avg_cost_micro_usd, round(avg(input_tokens), 6) avg_input_tokens,
  round(avg(output_tokens), 6) avg_output_tokens, round(avg(is_decline::INT), 6) decline_rate, round(avg(confidence), 6) avg_confidence,
  round(avg(num_citations), 6) avg_citations_per_query, round(avg(num_chunks), 6) avg_chunks_retrieved"""


def _snapshot(log: DataFrame) -> DataFrame:
    s = T.metrics_snapshot(log)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return s.select(
        "sample_size", text("window_start"), text("window_end"),
        *[r6(f"{p}_{k}_latency_ms").alias(f"{p}_{k}_latency_ms") for k in ("total", "retrieval", "generation") for p in ("p50", "p95")],
        r6(F.col("total_cost_usd") * 1000).alias("total_cost_milli_usd"),
        r6(F.col("avg_cost_per_query_usd") * 1000000).alias("avg_cost_micro_usd"),
        *[r6(c).alias(c) for c in ("avg_input_tokens", "avg_output_tokens", "decline_rate", "avg_confidence", "avg_citations_per_query", "avg_chunks_retrieved")],
    )


@query("metrics_snapshot", f"WITH {SQL_LOG} SELECT {_SQL_SNAPSHOT} FROM log")
def metrics_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return _snapshot(query_log(spark, root))


@query("metrics_snapshot_buffer", f"WITH {SQL_LOG} SELECT {_SQL_SNAPSHOT} FROM (SELECT * FROM log ORDER BY ts DESC, query_id DESC LIMIT 1000)")
def metrics_snapshot_buffer(spark: SparkSession, root: str) -> DataFrame:
    """The same figures over the ring buffer of the latest 1000 queries."""
    return _snapshot(T.last_n(query_log(spark, root), newest()))


_BUCKETS = "(VALUES (0, '<100ms', -1, 100), (1, '100-200ms', 100, 200), (2, '200-300ms', 200, 300), (3, '300-500ms', 300, 500), (4, '>500ms', 500, 1e18)) b(bucket, label, lo, hi)"


@query("latency_histogram", f"SELECT bucket::BIGINT bucket, label, count(event_id) n FROM {_BUCKETS} LEFT JOIN events ON value >= lo AND value < hi GROUP BY ALL")
def latency_histogram(spark: SparkSession, root: str) -> DataFrame:
    return T.latency_histogram(query_log(spark, root), "total_latency_ms").select(long("bucket").alias("bucket"), "label", "n")


@query(
    "category_rollup",
    f"WITH {SQL_LOG} SELECT category, count(*) queries, round(coalesce(avg(confidence) FILTER (NOT is_decline), 0), 3) avg_confidence FROM log GROUP BY category",
)
def category_rollup(spark: SparkSession, root: str) -> DataFrame:
    return T.category_rollup(query_log(spark, root))


_SQL_RECENT = "substr(query, 1, 80) query, round_even(total_latency_ms, 0)::BIGINT latency, round(confidence, 2) confidence, CASE WHEN is_decline THEN 'declined' ELSE 'answered' END status, num_citations::BIGINT citations"


@query("recent_10", f"WITH {SQL_LOG} SELECT query_id, {_SQL_RECENT} FROM log ORDER BY ts DESC, query_id DESC LIMIT 10")
def recent_10(spark: SparkSession, root: str) -> DataFrame:
    return T.recent_rows(query_log(spark, root), newest())


_SQL_LIVE = f"""WITH {SQL_LOG}, buf AS (SELECT * FROM log ORDER BY ts DESC, query_id DESC LIMIT 500),
  cats AS (SELECT category, count(*) q, round(coalesce(avg(confidence) FILTER (NOT is_decline), 0), 3) c FROM buf GROUP BY category),
  v AS (SELECT list_sort(list(total_latency_ms)) v FROM buf),
  totals AS (SELECT count(*) total_queries, count(*) FILTER (NOT is_decline) answered, count(*) FILTER (is_decline) declined,
    round(coalesce(avg(confidence) FILTER (NOT is_decline), 0), 3) avg_confidence,
    (SELECT round_even({sql_floor_rank('v', 50)}, 0)::BIGINT FROM v) p50, (SELECT round_even({sql_floor_rank('v', 95)}, 0)::BIGINT FROM v) p95,
    concat_ws(',', count(*) FILTER (total_latency_ms < 100), count(*) FILTER (total_latency_ms >= 100 AND total_latency_ms < 200),
      count(*) FILTER (total_latency_ms >= 200 AND total_latency_ms < 300), count(*) FILTER (total_latency_ms >= 300 AND total_latency_ms < 500),
      count(*) FILTER (total_latency_ms >= 500)) buckets FROM buf)"""


@query(
    "live_snapshot",
    f"""{_SQL_LIVE} SELECT t.*, (SELECT string_agg(category || '=' || q, ',' ORDER BY category) FROM cats) categories,
      (SELECT string_agg(round_even(total_latency_ms, 0)::BIGINT, ',' ORDER BY ts DESC, query_id DESC) FROM (SELECT * FROM buf ORDER BY ts DESC, query_id DESC LIMIT 10)) recent FROM totals t""",
)
def live_snapshot(spark: SparkSession, root: str) -> DataFrame:
    s = T.live_snapshot(query_log(spark, root), newest())
    return s.select(
        "total_queries", "answered", "declined", "avg_confidence", "p50", "p95",
        F.array_join(F.transform("latency_buckets", lambda n: n.cast("string")), ",").alias("buckets"),
        F.array_join(F.transform("categories", lambda c: F.concat(c["name"], F.lit("="), c["queries"].cast("string"))), ",").alias("categories"),
        F.array_join(F.transform("recent", lambda r: r["latency"].cast("string")), ",").alias("recent"),
    )


@query(
    "dashboard_ratios",
    f"{_SQL_LIVE} SELECT round(declined * 100.0::DOUBLE / total_queries, 1) decline_pct, round(answered * 100.0::DOUBLE / total_queries, 1) answer_pct, round((p50 + p95) / 2.0, 0)::BIGINT avg_latency FROM totals",
)
def dashboard_ratios(spark: SparkSession, root: str) -> DataFrame:
    return T.dashboard_ratios(T.live_snapshot(query_log(spark, root), newest()))


@query(
    "score_tiers",
    f"""WITH {SQL_LOG} SELECT query_id, CASE WHEN confidence >= 0.85 THEN 'good' WHEN confidence >= 0.70 THEN 'fair' ELSE 'poor' END score_tier,
      CASE WHEN is_decline THEN 'none' WHEN confidence >= 0.90 THEN 'high' WHEN confidence >= 0.75 THEN 'medium' ELSE 'low' END confidence_tier FROM log""",
)
def score_tiers(spark: SparkSession, root: str) -> DataFrame:
    return query_log(spark, root).select(
        "query_id", T.score_tier(F.col("confidence")).alias("score_tier"),
        T.confidence_tier(F.col("confidence"), F.col("is_decline")).alias("confidence_tier"),
    )


@query(
    "session_stats",
    f"""WITH {SQL_LOG} SELECT query_id, user_id, count(*) OVER w queries, count(*) FILTER (NOT is_decline) OVER w answered,
      count(*) FILTER (is_decline) OVER w declined, round(avg(total_latency_ms) OVER w + 1e-9, 6) avg_latency,
      round(avg(confidence) FILTER (NOT is_decline) OVER w + 1e-9, 6) avg_confidence
    FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def session_stats(spark: SparkSession, root: str) -> DataFrame:
    out = T.session_stats(query_log(spark, root), "user_id", "ts")
    return out.select(
        "query_id", "user_id", long("queries").alias("queries"), long("answered").alias("answered"), long("declined").alias("declined"),
        r6(F.col("avg_latency") + 1e-9).alias("avg_latency"), r6(F.col("avg_session_confidence") + 1e-9).alias("avg_confidence"),
    )


@query(
    "span_rollup",
    """SELECT event_id trace_id, CASE WHEN event_type = 'error' THEN 2 ELSE 3 END::BIGINT n_spans, 0.0::DOUBLE start_ms,
      round(CASE WHEN event_type = 'error' THEN value * 0.75 ELSE value END, 6) end_ms, (event_type = 'error')::BIGINT has_error FROM events""",
)
def span_rollup(spark: SparkSession, root: str) -> DataFrame:
    traces = query_log(spark, root).select(
        F.col("query_id").alias("trace_id"), "retrieval_latency_ms", "generation_latency_ms",
        (F.col("total_latency_ms") / 4).alias("citation_validation_latency_ms"),
        F.when(F.col("is_decline"), "generation").alias("failed_at"),
    )
    out = T.span_rollup(T.query_spans(traces))
    return out.select("trace_id", "n_spans", "start_ms", r6("end_ms").alias("end_ms"), long("has_error").alias("has_error"))


@query(
    "span_outputs",
    f"""WITH {sql_bm25(5)} SELECT query_id, count(*) num_chunks, string_agg(doc_id::VARCHAR || '::0::0', ',' ORDER BY rank) chunk_ids,
      round(sum(round(score, 4)), 4) score_sum, string_agg(lang, ',' ORDER BY rank) content_types FROM sparse JOIN documents USING (doc_id) GROUP BY query_id""",
)
def span_outputs(spark: SparkSession, root: str) -> DataFrame:
    hits = bm25_hits(spark, root, 5).withColumnRenamed("score", "rerank_score")
    rows = fetch_by_key(hits, chunk_view(spark, root).select("doc_id", "chunk_id", "content_type"), "doc_id")
    out = T.span_outputs(rows)
    return out.select(
        "query_id", "num_chunks", F.array_join("chunk_ids", ",").alias("chunk_ids"),
        F.round(F.aggregate("rerank_scores", F.lit(0.0), lambda a, x: a + x), 4).alias("score_sum"),
        F.array_join("content_types", ",").alias("content_types"),
    )


@query(
    "telemetry_rows",
    f"""WITH {sql_bm25(5)}, top AS (
      SELECT query_id, count(*) n, min_by(score, rank) s, min_by(lang, rank) t FROM sparse JOIN documents USING (doc_id) GROUP BY query_id)
    SELECT item_id query_id, substr(text, 1, 100) query, md5(text) trace_id, coalesce(s / 16, 0.0) > 0 has_retrieval, length(text)::BIGINT input_tokens,
      round(coalesce(quality::DOUBLE, 0), 6) confidence, coalesce(toxic = 1, true) is_decline, coalesce(quality, 0)::BIGINT num_citations,
      coalesce(n, 0)::BIGINT num_chunks_retrieved, round(coalesce(s, 0), 6) top_rerank_score, coalesce(t, 'unknown') top_content_type
    FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id LEFT JOIN top ON top.query_id = b.item_id""",
)
def telemetry_rows(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark items as queries; an item without a label had no response."""
    items = table(spark, root, "benchmark").join(
        table(spark, root, "labels").withColumnRenamed("doc_id", "item_id"), "item_id", "left"
    )
    responses = items.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.md5(F.encode("text", "UTF-8")).alias("trace_id"),
        F.lit(None).cast("double").alias("total_latency_ms"), F.lit(None).cast("double").alias("generation_latency_ms"),
        F.length("text").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"),
        F.col("quality").cast("double").alias("confidence"), (F.col("toxic") == 1).alias("is_decline"), F.col("quality").alias("num_citations"),
    )
    hits = fetch_by_key(bm25_hits(spark, root, 5), documents(spark, root).select("doc_id", "lang"), "doc_id")
    chunks = hits.select(
        "query_id", "rank", F.col("score").alias("rerank_score"), F.col("lang").alias("content_type"), (F.col("score") / 16).alias("retrieval_latency_ms")
    )
    out = T.telemetry_rows(responses, chunks)
    return out.select(
        "query_id", "query", "trace_id", (F.col("retrieval_latency_ms") > 0).alias("has_retrieval"), long("input_tokens").alias("input_tokens"),
        r6("confidence").alias("confidence"), "is_decline", long("num_citations").alias("num_citations"),
        long("num_chunks_retrieved").alias("num_chunks_retrieved"), r6("top_rerank_score").alias("top_rerank_score"), "top_content_type",
    )


_ROUTES = ", ".join(f"({i}, '{word}', '{category}')" for i, (word, category) in enumerate(T.ROUTES))


@query(
    "keyword_route",
    f"""SELECT doc_id, min_by(word, p) keyword, coalesce(min_by(category, p), 'other') category
    FROM documents LEFT JOIN (VALUES {_ROUTES}) r(p, word, category) ON contains(lower(text), word) GROUP BY doc_id""",
)
def keyword_route(spark: SparkSession, root: str) -> DataFrame:
    rows = documents(spark, root).select("doc_id", T.keyword_route(F.col("text")).alias("keyword"))
    return rows.select("doc_id", "keyword", T.route_category(F.col("keyword")).alias("category"))


@query(
    "served_answers",
    f"""WITH r AS (SELECT doc_id query_id, text, min_by(word, p) keyword, coalesce(min_by(category, p), 'other') category
      FROM documents LEFT JOIN (VALUES {_ROUTES}) r(p, word, category) ON contains(lower(text), word) WHERE trim(text) <> '' GROUP BY ALL)
    SELECT query_id, keyword, category, keyword IS NULL is_decline, 120.0::DOUBLE latency_ms,
      CASE WHEN keyword IS NULL THEN 0 ELSE round((850 + ('0x' || substr(md5(text), 1, 13))::BIGINT % 100 + 0.25) / 1000::DOUBLE, 2) END::DOUBLE confidence FROM r""",
)
def served_answers(spark: SparkSession, root: str) -> DataFrame:
    return T.served_answers(documents(spark, root), "doc_id", "text").drop("query")


@query("health", "SELECT 'ok' status, count(*) total_queries FROM events")
def health(spark: SparkSession, root: str) -> DataFrame:
    return query_log(spark, root).agg(F.count("*").alias("total_queries")).select(F.lit("ok").alias("status"), "total_queries")


_SQL_IN_BOUND = "count(total_latency_ms) n, true p50_in_bound, true p95_in_bound"


@query("latency_sketches", f"WITH {SQL_LOG} SELECT category, {_SQL_IN_BOUND} FROM log GROUP BY category")
def latency_sketches(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles by category from stored hourly sketches, with their ranks counted over the whole log.

    The sketches are a table; the period is answered from it alone.  The
    counts say whether each estimate keeps the error bound.
    """
    log = query_log(spark, root)
    stored = settled(SK.hourly_sketches(log, "ts", ["category"], ["total_latency_ms"]), "sketches")
    merged = SK.merged_sketches(stored, ["category"], ["total_latency_ms"])
    sketch = F.col("total_latency_ms")
    figures = merged.select("category", SK.count(sketch).alias("n"), *[SK.percentile(sketch, p).alias(f"p{p}") for p in (50, 95)])
    # One row for each category, met on that key; rows are counted before the exchange of the sums.
    rows = log.select("category", "total_latency_ms").join(figures, "category")
    value = F.col("total_latency_ms")
    counted = rows.groupBy("category", "n").agg(
        *[F.count_if(value < F.col(f"p{p}")).alias(f"below_{p}") for p in (50, 95)],
        *[F.count_if(value <= F.col(f"p{p}")).alias(f"upto_{p}") for p in (50, 95)],
    )

    def in_bound(p: int) -> Column:
        slack, wanted = SK.RANK_ERROR * F.col("n") + 1, F.col("n") * p / 100
        return ((F.col(f"below_{p}") <= wanted + slack) & (F.col(f"upto_{p}") >= wanted - slack)).alias(f"p{p}_in_bound")

    return counted.select("category", long("n").alias("n"), in_bound(50), in_bound(95))
