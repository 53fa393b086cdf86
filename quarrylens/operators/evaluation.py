"""Scores of answers, reports and the release gate."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.text import overlap_share, tokenize
from quarrylens.operators.models import Generator, generate
from quarrylens.operators.numbering import settled
from quarrylens.operators.prompt import context_block, prompt_messages
from quarrylens.operators.validation import (
    CITATION_DDL, DECLINE_MESSAGE, NO_CONTEXT, best_sentence, demote_low_confidence, enforce_citations, parse_responses,
)

# Fixed values -------------------------------------------------------------
FAITHFULNESS_THRESHOLD = 0.85
FAST_TRIPLETS = 3
# --------------------------------------------------------------------------

# Share of shared terms from which the default scorer calls a chunk relevant.
RELEVANT_SHARE = 0.5


def lexical_faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's terms found in the context.

    Like the next two a reproducible stand-in for a model-judged score.
    """
    return overlap_share(tokenize(answer), tokenize(context))


def lexical_recall(truth: Column, context: Column) -> Column:
    return overlap_share(tokenize(truth), tokenize(context))


def context_precision(ranked: DataFrame, relevant: Column) -> DataFrame:
    """Mean over relevant ranks of the share relevant up to that rank.

    ``ranked``: query_id, rank, at most the retrieval top-k rows per query.
    """
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.select("query_id", "rank", relevant.cast("int").alias("hit"))
    seen = rows.withColumn("hits", F.sum("hit").over(upto))
    return seen.groupBy("query_id").agg(
        F.avg(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("context_precision")
    )


def passes(faithfulness: Column, threshold: float = FAITHFULNESS_THRESHOLD) -> Column:
    """An unscored row does not pass."""
    return F.coalesce(faithfulness >= threshold, F.lit(False))


def _triplet_rows(triplets: DataFrame) -> DataFrame:
    """Triplets with the defaults of their optional fields; the context is one chunk."""
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")) if c in triplets.columns else F.lit("unknown")
    return triplets.select(
        "response_id", "query", "context", "ground_truth",
        named("doc_id").cast("string").alias("doc_id"), named("category").alias("category"), named("difficulty").alias("difficulty"),
    ).withColumn("chunk_id", F.concat("doc_id", F.lit("::eval::0")))


def _precision(answer: Column, truth: Column, context: Column) -> Column:
    target = F.when(F.coalesce(truth, F.lit("")) != "", truth).otherwise(answer)
    return F.when(lexical_recall(target, context) >= RELEVANT_SHARE, 1.0).otherwise(0.0)


def evaluate_through(
    triplets: DataFrame,
    make_generator: Callable[[], Generator],
    scorers: Scorers | None = None,
    system_prompt: str | None = None,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Prompt, generate, parse, enforce and score every golden triplet through the model slots.

    Columns as :func:`evaluate_triplets`, and ``latency_ms`` of the generation.
    The model's texts are written once, so a triplet is one call (up to three
    attempts) however often the result is read.  A triplet whose call fails
    keeps its row with the error, declined and unscored; scorers see the rest.
    """
    rows = _triplet_rows(triplets)
    chunk = rows.select(
        F.col("response_id").alias("query_id"), F.lit(1).alias("rank"), "chunk_id", "doc_id", F.lit(None).cast("string").alias("section_header"),
        F.lit(1).alias("page_number"), F.lit("prose").alias("content_type"), F.col("context").alias("content"),
    )
    asked = rows.select(F.col("response_id").alias("query_id"), "query")
    prompts = prompt_messages(context_block(asked, chunk), system_prompt)
    said = settled(generate(prompts, make_generator, wait).withColumnRenamed("query_id", "response_id"), "generated")
    pool = chunk.withColumnRenamed("query_id", "response_id").withColumn("position", F.lit(0))
    parsed = parse_responses(rows.select("response_id", "query").join(said.select("response_id", "text"), "response_id"), pool)
    checked = enforce_citations(parsed, pool).select("response_id", "answer", "is_decline", "confidence")
    joined = rows.join(checked, "response_id").join(said.select("response_id", F.col("error").alias("failure"), "latency_ms"), "response_id")
    scored = score_answers(joined, scorers)
    names = [m for m in (LEXICAL_SCORERS if scorers is None else scorers) if m != "context_precision"]
    precision = F.when(~F.col("is_decline"), _precision(F.col("answer"), F.col("ground_truth"), F.col("context")))
    own = precision if scorers is None or "context_precision" not in scorers else F.col("context_precision")
    return scored.select(
        "response_id", "query", "ground_truth", F.col("answer").alias("generated_answer"), "is_decline", "confidence", *names,
        own.alias("context_precision"), "doc_id", "category", "difficulty", F.col("failure").alias("error"), "latency_ms",
    )


def evaluate_triplets(triplets: DataFrame) -> DataFrame:
    """Answer, check and score every golden triplet.

    ``triplets``: response_id, query, context, ground_truth and optional
    doc_id, category, difficulty, section.  The context is the one chunk.
    """
    rows = _triplet_rows(triplets)
    best = rows.withColumn("best", best_sentence(F.col("query"), F.col("context")))
    found = F.coalesce(F.col("best.score"), F.lit(0.0)) > 0
    citation = F.struct(
        F.col("chunk_id"), F.col("doc_id"), F.lit(None).cast("string").alias("section_header"), F.lit(1).alias("page_number"),
        F.lit("prose").alias("content_type"), F.col("best.text").alias("exact_quote_context"),
    )
    answered = best.select(
        "response_id",
        F.when(found, F.col("best.text")).otherwise(DECLINE_MESSAGE).alias("answer"),
        F.when(found, F.col("best.score")).otherwise(0.0).alias("confidence"),
        (~found).alias("is_decline"),
        F.when(~found, NO_CONTEXT).alias("decline_reason"),
        F.when(found, F.array(citation)).otherwise(F.array().cast(f"array<{CITATION_DDL}>")).alias("citations"),
    )
    pool = rows.select("response_id", "chunk_id", F.col("context").alias("content"), F.lit(0).alias("position"))
    checked = enforce_citations(demote_low_confidence(answered), pool)
    joined = rows.join(checked, "response_id")
    live = ~F.col("is_decline")
    faithful = lexical_faithfulness(F.col("answer"), F.col("context"))
    recall = F.when(F.col("ground_truth") != "", lexical_recall(F.col("ground_truth"), F.col("context")))
    precision = _precision(F.col("answer"), F.col("ground_truth"), F.col("context"))
    return joined.select(
        "response_id", "query", "ground_truth", F.col("answer").alias("generated_answer"), "is_decline", "confidence",
        F.when(live, faithful).alias("faithfulness"),
        F.when(live, recall).alias("context_recall"),
        F.when(live, precision).alias("context_precision"),
        "doc_id", "category", "difficulty", F.lit(None).cast("string").alias("error"),
    )


def first_triplets(triplets: DataFrame, position: str, n: int = 0) -> DataFrame:
    """First ``n`` triplets in file order; zero keeps all."""
    return triplets.orderBy(position).limit(n) if n else triplets


def eval_report(results: DataFrame, threshold: float = FAITHFULNESS_THRESHOLD) -> DataFrame:
    """One row of means, rates and the gate; an empty set has null rates."""
    scored = F.col("faithfulness").isNotNull()
    mean = lambda c, among: F.coalesce(F.avg(F.when(among, F.col(c))), F.lit(0.0))
    everything = F.lit(True)
    report = results.agg(
        F.count("*").alias("total_triplets"),
        F.count_if(scored).alias("scored_triplets"),
        F.count_if(F.col("error").isNotNull()).alias("failed_triplets"),
        mean("faithfulness", scored).alias("avg_faithfulness"),
        mean("context_recall", scored).alias("avg_context_recall"),
        mean("context_precision", scored).alias("avg_context_precision"),
        F.avg(F.col("is_decline").cast("int")).alias("decline_rate"),
        mean("confidence", everything).alias("avg_confidence"),
        *([mean("latency_ms", everything).alias("avg_latency_ms")] if "latency_ms" in results.columns else []),
    )
    return report.withColumn("faithfulness_gate_threshold", F.lit(threshold)).withColumn(
        "passed_gate", F.col("avg_faithfulness") >= threshold
    )


def category_breakdown(results: DataFrame, threshold: float = FAITHFULNESS_THRESHOLD) -> DataFrame:
    """Mean faithfulness of the scored rows of each category."""
    return (
        results.filter(F.col("faithfulness").isNotNull())
        .groupBy("category")
        .agg(F.avg("faithfulness").alias("avg_faithfulness"), F.count("*").alias("num_triplets"))
        .withColumn("passed", F.col("avg_faithfulness") >= threshold)
    )


def gate_verdict(
    results: DataFrame, threshold: float = FAITHFULNESS_THRESHOLD, require_all_categories: bool = False
) -> DataFrame:
    """One row: passed, and every failure by scope, overall first.

    Both levels come from one pass: a rollup over the category.  Results with
    no score at all count as an overall mean of zero.
    """
    levels = (
        results.rollup("category")
        .agg(F.avg("faithfulness").alias("mean"), F.count("faithfulness").alias("scored"), F.grouping("category").alias("overall"))
    )
    overall = F.col("overall") == 1
    low = F.coalesce(F.col("mean"), F.lit(0.0)) < threshold
    counts = overall | (F.lit(require_all_categories) & (F.col("scored") > 0))
    failure = F.when(low & counts, F.struct((1 - F.col("overall")).alias("level"), F.coalesce("category", F.lit("overall")).alias("scope")))
    # Failures are one per category at most.
    verdict = levels.agg(
        F.coalesce(F.max(F.when(overall, F.col("mean"))), F.lit(0.0)).alias("avg_faithfulness"),
        F.array_sort(F.collect_list(failure)).alias("f"),
    )
    return verdict.select(
        "avg_faithfulness",
        F.lit(threshold).alias("threshold"),
        F.transform("f", lambda x: x["scope"]).alias("failures"),
        (F.size("f") == 0).alias("passed"),
    )


def report_text(report: dict) -> str:
    """Fixed-width text of a report row."""
    return "\n".join(f"{name:<30} {value}" for name, value in report.items())


# Scorers of (query, answer, context, ground truth) columns, by metric.
Scorers = dict[str, Callable[[Column, Column, Column, Column], Column]]

LEXICAL_SCORERS: Scorers = {
    "faithfulness": lambda query, answer, context, truth: lexical_faithfulness(answer, context),
    "context_recall": lambda query, answer, context, truth: F.when(truth != "", lexical_recall(truth, context)),
}


def score_answers(rows: DataFrame, scorers: Scorers | None = None, enabled: bool = True) -> DataFrame:
    """Adds one column per metric and ``error``.

    ``rows``: query, answer, context, ground_truth, is_decline.  A decline or a
    disabled scorer gives nulls and says why; a scorer that fails on a row
    should return null for it.
    """
    scorers = LEXICAL_SCORERS if scorers is None else scorers
    live = ~F.col("is_decline") & F.lit(enabled)
    arguments = [F.col(c) for c in ("query", "answer", "context", "ground_truth")]
    why = F.lit("Scorer disabled") if not enabled else F.when(F.col("is_decline"), "Skipped: decline response")
    return rows.select(
        "*", *[F.when(live, scorer(*arguments)).alias(name) for name, scorer in scorers.items()], why.cast("string").alias("error")
    )


def row_json(*columns: str) -> Column:
    """A row, or some of its columns, as JSON text with null fields."""
    return F.to_json(F.struct(*(columns or ("*",))), {"ignoreNullFields": "false"})
