"""Structured answers: extraction from text, rules, and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.json import strict_json
from quarrylens.functions.text import let, normalize_ws, overlap_share, strip, tokenize
from quarrylens.operators.unfold import unfold

# Fixed values -------------------------------------------------------------
MIN_QUOTE_CHARS = 10
CONFIDENCE_PENALTY = 0.2
DEMOTE_BELOW = 0.3
NO_CONTEXT = "no_relevant_context_found"
LOW_CONFIDENCE = "confidence_below_threshold"
DECLINE_REASONS = (
    "no_relevant_context_found",
    "confidence_below_threshold",
    "conflicting_information_in_context",
    "query_out_of_scope",
)
# --------------------------------------------------------------------------

# Wording of our own.
UNVERIFIED_MESSAGE = "The sources of this answer could not be verified."
DECLINE_MESSAGE = "The documents do not hold enough information to answer this question."

CITATION_DDL = (
    "struct<chunk_id:string,doc_id:string,section_header:string,page_number:int,content_type:string,"
    "exact_quote_context:string>"
)


def extract_json(text: Column) -> Column:
    """First balanced brace group of a text, code fences removed; else null.

    Braces are counted without regard to quoting.  The fold runs over the
    pieces between braces, not over characters.
    """
    unfenced = strip(F.regexp_replace(F.regexp_replace(text, r"(?U)```json\s*", ""), r"(?U)```\s*", ""))

    def group(body: Column) -> Column:
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(0).alias("end"))

        def step(s: Column, piece: Column) -> Column:
            turn = F.when(F.endswith(piece, F.lit("{")), 1).when(F.endswith(piece, F.lit("}")), -1).otherwise(0)
            depth, length = s["depth"] + turn, s["length"] + F.length(piece)
            closes = (s["end"] == 0) & (turn == -1) & (depth == 0)
            return F.struct(
                depth.alias("depth"), length.alias("length"), F.when(closes, length).otherwise(s["end"]).alias("end")
            )

        end = F.aggregate(F.split(body, r"(?<=[{}])"), zero, step, lambda s: s["end"])
        return let(end, lambda e: F.when(e > 0, F.substring(body, F.lit(1), e)))

    return let(unfenced, lambda t: F.when(F.contains(t, F.lit("{")), group(F.substring(t, F.instr(t, "{"), F.length(t)))))


def response_violations(
    query: Column, answer: Column, confidence: Column, is_decline: Column, decline_reason: Column, citations: Column
) -> Column:
    """Names of the rules a response breaks; empty when it is valid."""

    def rule(broken: Column, name: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(name))

    none = F.coalesce(F.size(citations), F.lit(0)) <= 0
    decline = F.coalesce(is_decline, F.lit(False))
    quote_broken = lambda c: (
        (F.length(F.coalesce(c["exact_quote_context"], F.lit(""))) < MIN_QUOTE_CHARS)
        | (strip(F.coalesce(c["exact_quote_context"], F.lit(""))) == "")
    )
    some = lambda test: F.coalesce(F.exists(citations, test), F.lit(False))
    return F.array_compact(
        F.array(
            rule(F.length(query) < 1, "query_empty"),
            rule(F.length(answer) < 1, "answer_empty"),
            rule(~confidence.between(0.0, 1.0), "confidence_range"),
            F.when(decline_reason.isNotNull() & ~decline_reason.isin(*DECLINE_REASONS), F.lit("decline_reason_unknown")),
            F.when(decline & decline_reason.isNull(), F.lit("decline_reason_missing")),
            F.when(~decline & none, F.lit("citations_missing")),
            F.when(some(lambda c: c["chunk_id"].isNull() | c["doc_id"].isNull()), F.lit("citation_field_missing")),
            F.when(some(lambda c: F.coalesce(c["page_number"] < 1, F.lit(True))), F.lit("citation_page")),
            F.when(some(quote_broken), F.lit("citation_quote")),
        )
    )


def demote_low_confidence(responses: DataFrame) -> DataFrame:
    """Answers below the confidence floor become declines without citations."""
    low = ~F.col("is_decline") & (F.col("confidence") < DEMOTE_BELOW)
    return (
        responses.withColumn("__low", low)
        .withColumn("is_decline", F.col("is_decline") | F.col("__low"))
        .withColumn("decline_reason", F.when(F.col("__low"), LOW_CONFIDENCE).otherwise(F.col("decline_reason")))
        .withColumn("citations", F.when(F.col("__low"), F.array().cast(f"array<{CITATION_DDL}>")).otherwise(F.col("citations")))
        .drop("__low")
    )


def content_lookup(pool: DataFrame, cited: DataFrame) -> DataFrame:
    """One content per cited (response_id, chunk_id): the last position wins.

    The winner is chosen on keys and numbers; contents are met last, and only
    those of cited chunks go on.  A position occurs once for each key.  All
    steps use one partitioning by the key, and the hashed side has no texts.
    """
    key = ["response_id", "chunk_id"]
    asked = cited.select(*key).distinct()
    last = pool.select(*key, "position").join(asked.hint("shuffle_hash"), key, "left_semi").groupBy(*key).agg(F.max("position").alias("__last"))
    met = pool.select(*key, "position", "content").join(last.hint("shuffle_hash"), key)
    return met.filter(F.col("position") == F.col("__last")).select(*key, "content")


def citation_verdicts(citations: DataFrame, pool: DataFrame, min_chars: int = MIN_QUOTE_CHARS) -> DataFrame:
    """Adds ``verdict`` to citation rows: unknown_chunk, too_short, not_verbatim or valid.

    ``citations``: response_id, position, chunk_id, quote.  The join key holds
    the response, so a chunk cited everywhere is no hot key.
    """
    # Contents are normalized once per chunk, not once per citation.
    known = content_lookup(pool, citations).select("response_id", "chunk_id", normalize_ws(F.col("content")).alias("normal"), F.lit(True).alias("found"))
    joined = citations.join(known, ["response_id", "chunk_id"], "left")
    quote = strip(F.col("quote"))
    verdict = (
        F.when(F.col("found").isNull(), "unknown_chunk")
        .when(F.length(quote) < min_chars, "too_short")
        .when(~F.contains(F.col("normal"), normalize_ws(quote)), "not_verbatim")
        .otherwise("valid")
    )
    return joined.withColumn("verdict", verdict).select(*citations.columns, "verdict")


def enforce_citations(responses: DataFrame, pool: DataFrame, strict: bool = False, min_chars: int = MIN_QUOTE_CHARS) -> DataFrame:
    """Drop invalid citations, lower the confidence, decline when none is left.

    Strict mode fails the job on the first invalid citation instead.
    """
    cited = unfold(responses.filter(~F.col("is_decline")), ["response_id"], F.col("citations"), "citation", "position")
    rows = cited.select(
        "response_id", "position", "citation.chunk_id", F.col("citation.exact_quote_context").alias("quote"), "citation"
    )
    judged = citation_verdicts(rows, pool, min_chars)
    valid = F.col("verdict") == "valid"
    if strict:
        checked = F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("citation "), F.col("chunk_id"), F.lit(": "), F.col("verdict"))).cast("boolean"))
        judged = judged.filter(checked)
    tally = judged.groupBy("response_id").agg(
        F.count_if(~valid).alias("__invalid"),
        F.array_sort(F.collect_list(F.when(valid, F.struct("position", "citation")))).alias("__kept"),
    )
    joined = responses.join(tally, "response_id", "left")
    invalid = F.coalesce("__invalid", F.lit(0))
    touched = (invalid > 0) & ~F.col("is_decline")
    refused = touched & (F.size("__kept") == 0)
    kept = F.transform("__kept", lambda k: k["citation"])
    nothing = F.lit(None).cast("string")
    out = joined.select(
        *[c for c in responses.columns if c not in ("confidence", "is_decline", "decline_reason", "answer", "citations", "metric_value", "metric_unit")],
        F.when(refused, F.lit(0.0))
        .when(touched, F.greatest(F.lit(0.0), F.col("confidence") - CONFIDENCE_PENALTY * invalid))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        F.when(refused, True).otherwise(F.col("is_decline")).alias("is_decline"),
        F.when(refused, NO_CONTEXT).otherwise(F.col("decline_reason")).alias("decline_reason"),
        F.when(refused, UNVERIFIED_MESSAGE).otherwise(F.col("answer")).alias("answer"),
        F.when(refused, F.array().cast(f"array<{CITATION_DDL}>")).when(touched, kept).otherwise(F.col("citations")).alias("citations"),
        *[F.when(refused, nothing).otherwise(F.col(c)).alias(c) for c in ("metric_value", "metric_unit") if c in responses.columns],
    )
    # A response nobody touched was checked against the floor when it was made.
    return demote_low_confidence(out)


def decline(reason: str = NO_CONTEXT, message: str | None = None) -> list[Column]:
    """Columns of a well-formed decline."""
    return [
        F.lit(message or DECLINE_MESSAGE).alias("answer"),
        F.lit(0.0).alias("confidence"),
        F.lit(True).alias("is_decline"),
        F.lit(reason).alias("decline_reason"),
        F.array().cast(f"array<{CITATION_DDL}>").alias("citations"),
    ]


def enrich_citations(citations: DataFrame, pool: DataFrame) -> DataFrame:
    """Fill absent citation fields from the cited chunk; unknown chunks go.

    ``citations``: response_id, position, ``raw`` (variant of one citation).
    A key that is present keeps its value, an explicit null included.
    """
    text = lambda key, kind: F.try_variant_get("raw", f"$.{key}", kind)
    present = lambda key: F.array_contains(F.json_object_keys(F.to_json("raw")), key)
    rows = citations.withColumn("chunk_id", F.coalesce(text("chunk_id", "string"), F.lit("")))
    known = pool.groupBy("response_id", "chunk_id").agg(
        F.max_by(F.struct("doc_id", "section_header", "page_number", "content_type"), "position").alias("chunk")
    )
    fill = lambda key, kind, source: F.when(present(key), text(key, kind)).otherwise(source.cast(kind)).alias(key)
    return rows.join(known, ["response_id", "chunk_id"]).select(
        "response_id",
        "position",
        "chunk_id",
        fill("doc_id", "string", F.col("chunk.doc_id")),
        fill("section_header", "string", F.col("chunk.section_header")),
        # Pages are 0 when unknown at retrieval, but at least 1 in a citation.
        fill("page_number", "int", F.greatest(F.coalesce("chunk.page_number", F.lit(1)), F.lit(1))),
        fill("content_type", "string", F.col("chunk.content_type")),
        text("exact_quote_context", "string").alias("exact_quote_context"),
    )


def parse_responses(raw: DataFrame, pool: DataFrame) -> DataFrame:
    """Model text to validated responses; whatever fails becomes a decline.

    ``raw``: response_id, query, text.  Adds ``violations`` for the record.
    """
    parsed = raw.select(
        "response_id", "query", strict_json(extract_json(F.col("text"))).alias("v")
    )
    get = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    # A citation is kept as the variant it is; the list is one row's own.
    cites = unfold(parsed, ["response_id"], get("citations", "array<variant>"), "raw", "position")
    filled = enrich_citations(cites, pool)
    per_response = filled.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("position", F.struct("chunk_id", "doc_id", "section_header", "page_number", "content_type", "exact_quote_context").alias("c")))).alias("__c")
    )
    joined = parsed.join(per_response, "response_id", "left").select(
        "response_id",
        "query",
        F.col("v").isNull().alias("unparsed"),
        get("answer", "string").alias("answer"),
        get("confidence", "double").alias("confidence"),
        F.coalesce(get("is_decline", "boolean"), F.lit(False)).alias("is_decline"),
        get("decline_reason", "string").alias("decline_reason"),
        get("metric_value", "string").alias("metric_value"),
        get("metric_unit", "string").alias("metric_unit"),
        F.coalesce(F.transform("__c", lambda x: x["c"]), F.array().cast(f"array<{CITATION_DDL}>")).alias("citations"),
    )
    broken = F.when(F.col("unparsed"), F.array(F.lit("not_json"))).otherwise(
        response_violations(
            F.col("query"), F.col("answer"), F.col("confidence"), F.col("is_decline"), F.col("decline_reason"), F.col("citations")
        )
    )
    judged = joined.withColumn("violations", broken)
    bad = F.size("violations") > 0
    good = {c: F.col(c) for c in ("answer", "confidence", "is_decline", "decline_reason", "metric_value", "metric_unit", "citations")}
    fallback = {
        "answer": F.lit(DECLINE_MESSAGE),
        "confidence": F.lit(0.0),
        "is_decline": F.lit(True),
        "decline_reason": F.lit(NO_CONTEXT),
        "metric_value": F.lit(None).cast("string"),
        "metric_unit": F.lit(None).cast("string"),
        "citations": F.array().cast(f"array<{CITATION_DDL}>"),
    }
    out = judged.select(
        "response_id", "query", "violations", *[F.when(bad, fallback[c]).otherwise(good[c]).alias(c) for c in good]
    )
    trimmed = F.transform("citations", lambda c: c.withField("exact_quote_context", strip(c["exact_quote_context"])))
    return demote_low_confidence(out.withColumn("citations", trimmed))


def best_sentence(query: Column, content: Column) -> Column:
    """Struct (score, text) of the content sentence sharing most query terms.

    The reproducible default of the generator slot; ties go to the earlier one.
    """
    sentences = F.filter(F.split(content, r"(?<=[.!?])\s+|\n+"), lambda s: F.length(strip(s)) >= MIN_QUOTE_CHARS)

    def pick(terms: Column) -> Column:
        scored = F.transform(
            sentences,
            lambda s, i: F.struct(
                F.round(F.coalesce(overlap_share(terms, tokenize(s)), F.lit(0.0)), 9).alias("score"),
                (-i).alias("order"),
                strip(s).alias("text"),
            ),
        )
        return F.array_max(scored)

    return let(tokenize(query), pick)
