"""Query telemetry: records, snapshots, roll-ups, routing and traces."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import digest_number
from quarrylens.operators.percentiles import percentile_exclusive
from quarrylens.operators.running import running_aggregates

# Fixed values -------------------------------------------------------------
USD_PER_INPUT_TOKEN = 0.15e-6
USD_PER_OUTPUT_TOKEN = 0.60e-6
LOGGED_QUERY_CHARS = 100
METRICS_BUFFER = 1000
LIVE_BUFFER = 500
RECENT_ROWS = 10
RECENT_QUERY_CHARS = 80
TRACED_ANSWER_CHARS = 200
BUCKET_EDGES_MS = (100, 200, 300, 500)
BUCKET_LABELS = ("<100ms", "100-200ms", "200-300ms", "300-500ms", ">500ms")
# Keywords in priority order, each with the category it routes to.
ROUTES = (
    ("commission", "commission"),
    ("return", "returns"),
    ("payment", "payment"),
    ("shipping", "shipping"),
    ("rto", "rto"),
    ("catalog", "catalog"),
    ("gst", "onboarding"),
    ("variant", "catalog"),
)
UNROUTED_CATEGORY = "other"
LATENCY_FLOOR_MS = 120
SCORE_TIERS = ((0.85, "good"), (0.70, "fair"))
CONFIDENCE_TIERS = ((0.90, "high"), (0.75, "medium"))
# --------------------------------------------------------------------------


def telemetry_rows(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """One log row per query from its response and its retrieved chunks.

    ``responses``: query_id, query, trace_id, latencies, token counts and
    nullable confidence, is_decline, num_citations (null: no response).
    ``chunks``: query_id, rank, rerank_score, content_type,
    retrieval_latency_ms; the best-ranked one describes the query.
    """
    first = chunks.groupBy("query_id").agg(
        F.count("*").alias("num_chunks"),
        F.min_by(F.struct("rerank_score", "content_type", "retrieval_latency_ms"), F.col("rank")).alias("top"),
    )
    joined = responses.join(first, "query_id", "left")
    zero = F.lit(0)
    return joined.select(
        "query_id",
        F.substring("query", 1, LOGGED_QUERY_CHARS).alias("query"),
        "trace_id",
        F.coalesce("total_latency_ms", F.lit(0.0)).alias("total_latency_ms"),
        F.coalesce("top.retrieval_latency_ms", F.lit(0.0)).alias("retrieval_latency_ms"),
        F.coalesce("generation_latency_ms", F.lit(0.0)).alias("generation_latency_ms"),
        F.coalesce("input_tokens", zero).alias("input_tokens"),
        F.coalesce("output_tokens", zero).alias("output_tokens"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("is_decline", F.lit(True)).alias("is_decline"),
        F.coalesce("num_citations", zero).alias("num_citations"),
        F.coalesce("num_chunks", zero).alias("num_chunks_retrieved"),
        F.coalesce("top.rerank_score", F.lit(0.0)).alias("top_rerank_score"),
        F.coalesce("top.content_type", F.lit("unknown")).alias("top_content_type"),
    )


def query_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens * F.lit(USD_PER_INPUT_TOKEN) + output_tokens * F.lit(USD_PER_OUTPUT_TOKEN)


def last_n(log: DataFrame, newest_first: list[Column], n: int | None = METRICS_BUFFER) -> DataFrame:
    """The latest ``n`` rows; none or zero keeps all.

    Each task keeps its own latest n, which are merged: the log is not sorted.
    """
    return log.orderBy(*newest_first).limit(n) if n else log


def metrics_snapshot(log: DataFrame) -> DataFrame:
    """One row of window, percentile, cost, token and quality figures."""
    cost = query_cost(F.col("input_tokens"), F.col("output_tokens"))
    plain = log.agg(
        F.count("*").alias("sample_size"),
        F.min("ts").alias("window_start"),
        F.max("ts").alias("window_end"),
        F.sum(cost).alias("total_cost_usd"),
        F.avg(cost).alias("avg_cost_per_query_usd"),
        F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("output_tokens").alias("avg_output_tokens"),
        F.avg(F.col("is_decline").cast("int")).alias("decline_rate"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("num_citations").alias("avg_citations_per_query"),
        F.avg("num_chunks").alias("avg_chunks_retrieved"),
    )
    kinds = ("total", "retrieval", "generation")
    melted = log.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_latency_ms").alias("ms")) for k in kinds])).alias("m")
    ).select("m.kind", "m.ms")
    by_kind = percentile_exclusive(melted, ["kind"], "ms", [50, 95])
    wide = by_kind.agg(
        *[
            F.max(F.when(F.col("kind") == k, F.col(p))).alias(f"{p}_{k}_latency_ms")
            for k in kinds
            for p in ("p50", "p95")
        ]
    )
    return _one_row(plain, wide).filter(F.col("sample_size") > 0)


def _one_row(*parts: DataFrame) -> DataFrame:
    """Merge single-row frames with different columns by stacking them."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def latency_buckets(latency: str) -> list[Column]:
    """Counts below each edge and beyond the last; empty ones stay, as zero."""
    lows = (None, *BUCKET_EDGES_MS)
    highs = (*BUCKET_EDGES_MS, None)
    counts = []
    for low, high in zip(lows, highs):
        inside = F.col(latency).isNotNull()
        inside = inside if low is None else inside & (F.col(latency) >= low)
        inside = inside if high is None else inside & (F.col(latency) < high)
        counts.append(F.count_if(inside))
    return counts


def latency_histogram(log: DataFrame, latency: str) -> DataFrame:
    counts = log.agg(*[c.alias(f"b{i}") for i, c in enumerate(latency_buckets(latency))])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("bucket"), F.lit(label).alias("label"), F.col(f"b{i}").alias("n"))
                    for i, label in enumerate(BUCKET_LABELS)
                ]
            )
        )
    )


def category_rollup(log: DataFrame) -> DataFrame:
    """Queries per category, and the mean confidence of the answered ones."""
    answered = F.when(~F.col("is_decline"), F.col("confidence"))
    return log.groupBy("category").agg(
        F.count("*").alias("queries"), F.round(F.coalesce(F.avg(answered), F.lit(0.0)), 3).alias("avg_confidence")
    )


def recent_rows(log: DataFrame, newest_first: list[Column], n: int = RECENT_ROWS) -> DataFrame:
    return last_n(log, newest_first, n).select(
        *[c for c in ("query_id",) if c in log.columns],
        F.substring("query", 1, RECENT_QUERY_CHARS).alias("query"),
        F.bround(F.col("total_latency_ms")).cast("long").alias("latency"),
        F.round("confidence", 2).alias("confidence"),
        F.when(F.col("is_decline"), "declined").otherwise("answered").alias("status"),
        F.col("num_citations").alias("citations"),
    )


def live_snapshot(log: DataFrame, newest_first: list[Column], n: int = LIVE_BUFFER) -> DataFrame:
    """Totals, percentiles, buckets, categories and recent rows of the buffer.

    The buffer holds ``n`` rows at most, so its lists are bounded.  An empty
    log gives one row of zeros and empty lists.
    """
    buffer = last_n(log, newest_first, n)
    answered = F.when(~F.col("is_decline"), F.col("confidence"))
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "query_id", "query", "total_latency_ms", "confidence", "is_decline", "num_citations"))))
    totals = buffer.agg(
        F.count("*").alias("total_queries"),
        F.count_if(~F.col("is_decline")).alias("answered"),
        F.count_if(F.col("is_decline")).alias("declined"),
        F.round(F.coalesce(F.avg(answered), F.lit(0.0)), 3).alias("avg_confidence"),
        F.array_sort(F.collect_list("total_latency_ms")).alias("ordered"),
        F.array(*latency_buckets("total_latency_ms")).alias("latency_buckets"),
        F.slice(newest, 1, RECENT_ROWS).alias("latest"),
    )
    categories = category_rollup(buffer).agg(
        F.array_sort(F.collect_list(F.struct(F.col("category").alias("name"), "queries", "avg_confidence"))).alias("categories")
    )
    # "latest" and "ordered" are at most n items long.
    at = lambda p: F.bround(
        F.coalesce(F.get("ordered", F.greatest(F.lit(1), F.floor(F.size("ordered") * p / 100)) - 1), F.lit(0.0))
    ).cast("long")
    recent = F.transform(
        "latest",
        lambda r: F.struct(
            F.substring(r["query"], 1, RECENT_QUERY_CHARS).alias("query"),
            F.bround(r["total_latency_ms"]).cast("long").alias("latency"),
            F.round(r["confidence"], 2).alias("confidence"),
            F.when(r["is_decline"], "declined").otherwise("answered").alias("status"),
            r["num_citations"].alias("citations"),
        ),
    )
    snapshot = totals.select(
        "total_queries", "answered", "declined", "avg_confidence",
        at(50).alias("p50"), at(95).alias("p95"), "latency_buckets", recent.alias("recent"),
    )
    return _one_row(snapshot, categories)


def keyword_route(text: Column) -> Column:
    """First keyword, in priority order, found in the text; null when none is."""
    low = F.lower(text)
    words = F.array(*[F.lit(word) for word, _ in ROUTES])
    return F.get(F.filter(words, lambda w: F.contains(low, w)), F.lit(0))


def route_category(keyword: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in ROUTES for x in pair])
    return F.coalesce(mapping[keyword], F.lit(UNROUTED_CATEGORY))


def served_answers(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """What the query endpoint returns: blank queries rejected, others routed.

    The confidence of an answered query is a reproducible number of its text.
    """
    asked = queries.filter(F.trim(F.col(query)) != "")
    keyword = keyword_route(F.col(query))
    routed = asked.select(F.col(query_id).alias("query_id"), F.col(query).alias("query"), keyword.alias("keyword"))
    return routed.select(
        "*",
        route_category(F.col("keyword")).alias("category"),
        F.col("keyword").isNull().alias("is_decline"),
        F.when(F.col("keyword").isNull(), 0.0).otherwise(F.round((850 + F.pmod(digest_number(F.col("query")), F.lit(100)) + 0.25) / 1000, 2)).alias("confidence"),
        F.lit(float(LATENCY_FLOOR_MS)).alias("latency_ms"),
    )


def dashboard_ratios(totals: DataFrame) -> DataFrame:
    """Decline and answer percentages and the mean of p50 and p95."""
    share = lambda part: F.coalesce(F.try_divide(F.col(part) * 100.0, F.col("total_queries")), F.lit(0.0))
    return totals.select(
        F.round(share("declined"), 1).alias("decline_pct"),
        F.round(share("answered"), 1).alias("answer_pct"),
        F.round((F.col("p50") + F.col("p95")) / 2).cast("long").alias("avg_latency"),
    )


def tier(score: Column, tiers: tuple[tuple[float, str], ...], lowest: str) -> Column:
    out = F.when(score >= tiers[0][0], tiers[0][1])
    for edge, name in tiers[1:]:
        out = out.when(score >= edge, name)
    return out.otherwise(lowest)


def score_tier(score: Column) -> Column:
    return tier(score, SCORE_TIERS, "poor")


def confidence_tier(confidence: Column, is_decline: Column) -> Column:
    return F.when(is_decline, "none").otherwise(tier(confidence, CONFIDENCE_TIERS, "low"))


def session_stats(log: DataFrame, session: str, ts: str) -> DataFrame:
    """Counters and means of each session so far, at every query.

    Confidence is averaged over the answered queries only.
    """
    declined = F.col("is_decline").cast("int")
    out = running_aggregates(
        log,
        keys=[session],
        order=ts,
        bucket=F.date_trunc("hour", F.col(ts)),
        sums={
            "queries": F.lit(1),
            "declined": declined,
            "_latency": F.col("total_latency_ms"),
            "_confidence": F.when(~F.col("is_decline"), F.col("confidence")).otherwise(0.0),
        },
    )
    answered = F.col("queries") - F.col("declined")
    return out.select(
        *log.columns,
        "queries",
        answered.alias("answered"),
        "declined",
        (F.col("_latency") / F.col("queries")).alias("avg_latency"),
        F.try_divide("_confidence", answered).alias("avg_session_confidence"),
    )


def query_spans(traces: DataFrame) -> DataFrame:
    """Child spans of a traced query: retrieval, generation, citation check.

    ``traces``: trace_id, one latency per stage and a nullable ``failed_at``
    naming the stage that raised; the stages after it never ran.  Times are
    milliseconds from the start of the trace.
    """
    stages = ("retrieval", "generation", "citation_validation")
    took = [F.coalesce(F.col(f"{s}_latency_ms"), F.lit(0.0)) for s in stages]
    start = F.lit(0.0)
    spans = []
    for i, stage in enumerate(stages):
        spans.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(stage).alias("span"),
                start.alias("start_ms"),
                (start + took[i]).alias("end_ms"),
                F.when(F.col("failed_at") == stage, "error").otherwise("ok").alias("status"),
            )
        )
        start = start + took[i]
    last = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("failed_at")), F.lit(0))
    ran = F.filter(F.array(*spans), lambda s: (last == 0) | (s["position"] <= last))
    return traces.select("trace_id", F.explode(ran).alias("s")).select("trace_id", "s.*")


def span_rollup(spans: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Parent span of each trace from its child spans."""
    return spans.groupBy(trace).agg(
        F.count("*").alias("n_spans"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.max((F.col("status") == "error").cast("int")).alias("has_error"),
    )


def traced(name: str, sink: list[dict] | None, trace_id: str = "") -> Callable:
    """Decorator of a driver-side step: appends its span row to ``sink``.

    Without a sink tracing is off and the step runs bare.  An error is recorded
    and raised again.  The rows fit :func:`span_rollup`.
    """

    def wrap(step: Callable) -> Callable:
        @functools.wraps(step)
        def run(*args, **kwargs):  # noqa: ANN002, ANN003, ANN202
            if sink is None:
                return step(*args, **kwargs)
            start, status = time.time() * 1000, "error"
            try:
                out = step(*args, **kwargs)
                status = "ok"
                return out
            finally:
                sink.append(dict(trace_id=trace_id, span=name, start_ms=start, end_ms=time.time() * 1000, status=status))

        return run

    return wrap


def span_outputs(retrieved: DataFrame) -> DataFrame:
    """Retrieval span summary: chunk count, ids and rounded scores by rank.

    A query has at most the final top-k chunks, so its lists are short.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "rerank_score", "content_type")))
    return retrieved.groupBy("query_id").agg(F.count("*").alias("num_chunks"), rows.alias("r")).select(
        "query_id",
        "num_chunks",
        F.transform("r", lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.transform("r", lambda x: F.round(x["rerank_score"], 4)).alias("rerank_scores"),
        F.transform("r", lambda x: x["content_type"]).alias("content_types"),
    )


def answer_span(answers: DataFrame) -> DataFrame:
    """Generation span summary: the answer cut short, and its verdict fields."""
    return answers.select(
        "query_id",
        F.substring("answer", 1, TRACED_ANSWER_CHARS).alias("answer"),
        "confidence",
        "is_decline",
        F.size("citations").alias("num_citations"),
    )


def report_text(snapshot: dict) -> str:
    """Fixed-width text of one snapshot row, for a terminal."""
    lines = [f"{'metric':<28} {'value':>16}", "-" * 45]
    for name, value in snapshot.items():
        shown = f"{value:.4f}" if isinstance(value, float) else str(value)
        lines.append(f"{name:<28} {shown:>16}")
    return "\n".join(lines)
