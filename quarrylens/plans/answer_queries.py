"""Queries over prompts, structured answers and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.json import strict_json
from quarrylens.operators import prompt as P
from quarrylens.operators import validation as V
from quarrylens.operators.sizing import fetch_by_key
from quarrylens.operators.unfold import unfold
from quarrylens.plans.catalog import documents, long, query, r6, sql_normalize, sql_share, sql_strip, sql_tokens, table
from quarrylens.plans.retrieval_queries import bm25_hits, chunk_view, sql_bm25


def retrieved(spark: SparkSession, root: str, k: int = 5) -> DataFrame:
    """The best documents of every benchmark item, as prompt chunks."""
    return fetch_by_key(bm25_hits(spark, root, k), chunk_view(spark, root), "doc_id").withColumn("page_number", F.lit(1))


def asked(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# Chunks of French documents are shown as tables, so that both forms occur.
_SQL_FORMATTED = f"""{sql_bm25(5)},
formatted AS (
  SELECT query_id, rank, '[CHUNK ' || rank || '] chunk_id=' || doc_id || '::0::0 | doc=' || doc_id || ' | section=' || source || ' | page=1 | type=' ||
    CASE WHEN lang = 'fr' THEN 'table' || chr(10) || '```' || chr(10) || text || chr(10) || '```' ELSE lang || chr(10) || text END f
  FROM sparse JOIN documents USING (doc_id)),
used AS (SELECT *, sum(length(f)) OVER (PARTITION BY query_id ORDER BY rank) used FROM formatted),
kept AS (SELECT * FROM used WHERE rank = 1 OR used <= 24000),
ctx AS (
  SELECT item_id query_id, text query, count(f) kept, coalesce(max(used), 0) total_chars,
    coalesce(string_agg(f, chr(10) || chr(10) ORDER BY rank), 'No relevant context found.') context
  FROM benchmark LEFT JOIN kept ON query_id = item_id GROUP BY ALL)"""


def _prompt_chunks(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("content_type") == "fr", "table").otherwise(F.col("content_type"))
    return retrieved(spark, root).withColumn("content_type", kind)


@query("format_chunk", f"WITH {_SQL_FORMATTED} SELECT query_id, rank, md5(f) digest, length(f)::BIGINT n_chars FROM formatted")
def format_chunk(spark: SparkSession, root: str) -> DataFrame:
    names = ("rank", "chunk_id", "doc_id", "section_header", "page_number", "content_type", "content")
    rows = _prompt_chunks(spark, root).select("query_id", "rank", P.format_chunk(*[F.col(n) for n in names]).alias("f"))
    return rows.select("query_id", long("rank").alias("rank"), F.md5(F.encode("f", "UTF-8")).alias("digest"), long(F.length("f")).alias("n_chars"))


@query("context_budget", f"WITH {_SQL_FORMATTED} SELECT query_id, rank, used::BIGINT used FROM kept")
def context_budget(spark: SparkSession, root: str) -> DataFrame:
    rows = P.context_rows(_prompt_chunks(spark, root))
    return rows.select("query_id", long("rank").alias("rank"), long("used").alias("used"))


def _contexts(spark: SparkSession, root: str) -> DataFrame:
    return P.context_block(asked(spark, root), _prompt_chunks(spark, root))


@query("context_block", f"WITH {_SQL_FORMATTED} SELECT query_id, kept::BIGINT kept, total_chars::BIGINT total_chars, md5(context) digest FROM ctx")
def context_block(spark: SparkSession, root: str) -> DataFrame:
    return _contexts(spark, root).select(
        "query_id", long("kept").alias("kept"), long("total_chars").alias("total_chars"), F.md5(F.encode("context", "UTF-8")).alias("digest")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEAD, _MIDDLE, _TAIL = (_quoted(part) for part in P.USER_TEMPLATE)


@query(
    "prompt_messages",
    f"""WITH {_SQL_FORMATTED} SELECT query_id, 'system' AS role, {len(P.SYSTEM_PROMPT)}::BIGINT n_chars, md5({_quoted(P.SYSTEM_PROMPT)}) digest FROM ctx
    UNION ALL SELECT query_id, 'user', length({_HEAD} || context || {_MIDDLE} || query || {_TAIL}), md5({_HEAD} || context || {_MIDDLE} || query || {_TAIL}) FROM ctx""",
)
def prompt_messages(spark: SparkSession, root: str) -> DataFrame:
    rows = P.prompt_messages(_contexts(spark, root)).select("query_id", F.explode("messages").alias("m"))
    return rows.select("query_id", "m.role", long(F.length("m.content")).alias("n_chars"), F.md5(F.encode("m.content", "UTF-8")).alias("digest"))


# Responses made from the documents -----------------------------------------
# Each document answers with its own text.  It is cited verbatim, with other
# white space, reversed (no longer verbatim), by a two-character quote, and,
# for long documents, under an id nobody retrieved.


def _citation(chunk_id: Column, quote: Column) -> Column:
    return F.struct(
        chunk_id.alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("section_header"),
        F.lit(1).alias("page_number"), F.lit("prose").alias("content_type"), quote.alias("exact_quote_context"),
    )


def _at(n: int) -> Column:
    """Where a quote of n characters starts: anywhere in the text, by the document's id."""
    return (1 + F.pmod(F.col("doc_id") * 7919, F.greatest(F.length("text") - n, F.lit(1)))).cast("int")


def _sql_cut(n: int) -> str:
    return f"substr(text, 1 + (doc_id * 7919) % greatest(length(text) - {n}, 1), {n})"


def _cut(n: int) -> Column:
    return F.substring(F.col("text"), _at(n), F.lit(n))


def _responses(spark: SparkSession, root: str) -> DataFrame:
    own = F.concat(F.col("doc_id").cast("string"), F.lit("::0::0"))
    text = F.col("text")
    cites = F.array(
        _citation(own, _cut(60)),
        _citation(own, F.replace(_cut(50), F.lit(" "), F.lit("\n  "))),
        F.when(F.col("lang") != "en", _citation(own, F.reverse(_cut(40)))),
        F.when(F.col("lang") == "fr", _citation(own, _cut(2))),
        F.when(F.col("n_chars") > 2000, _citation(F.lit("missing::0::0"), _cut(60))),
    )
    return documents(spark, root).select(
        F.col("doc_id").alias("response_id"),
        text.alias("answer"),
        (0.25 + F.least(F.col("n_chars"), F.lit(4096)) / 8192).alias("confidence"),
        (F.col("source") == "src0").alias("is_decline"),
        F.when(F.col("source") == "src0", "query_out_of_scope").alias("decline_reason"),
        F.array_compact(cites).alias("citations"),
    )


def _pool(spark: SparkSession, root: str) -> DataFrame:
    rows = chunk_view(spark, root)
    return rows.select(
        F.col("doc_id").alias("response_id"), "chunk_id", "content", F.lit(0).alias("position"), F.col("doc_id").cast("string").alias("doc_id"),
        "section_header", F.lit(0).alias("page_number"), "content_type",
    )


_SQL_CITED = f"""
raw_cites AS (
  SELECT doc_id response_id, unnest(list_filter([
      {{'known': true, 'p': 0, 'q': {_sql_cut(60)}}},
      {{'known': true, 'p': 1, 'q': replace({_sql_cut(50)}, ' ', chr(10) || '  ')}},
      CASE WHEN lang <> 'en' THEN {{'known': true, 'p': 2, 'q': reverse({_sql_cut(40)})}} END,
      CASE WHEN lang = 'fr' THEN {{'known': true, 'p': 3, 'q': {_sql_cut(2)}}} END,
      CASE WHEN n_chars > 2000 THEN {{'known': false, 'p': 4, 'q': {_sql_cut(60)}}} END], lambda c: c IS NOT NULL)) c, text FROM documents),
judged AS (
  SELECT response_id, c.p p, CASE WHEN NOT c.known THEN 'unknown_chunk' WHEN length({sql_strip('c.q')}) < 10 THEN 'too_short'
    WHEN NOT contains({sql_normalize('text')}, {sql_normalize(sql_strip('c.q'))}) THEN 'not_verbatim' ELSE 'valid' END verdict FROM raw_cites)"""


@query("citation_verdict", f"WITH {_SQL_CITED} SELECT response_id, (row_number() OVER (PARTITION BY response_id ORDER BY p) - 1)::BIGINT AS position, verdict FROM judged")
def citation_verdict(spark: SparkSession, root: str) -> DataFrame:
    rows = unfold(_responses(spark, root), ["response_id"], F.col("citations"), "c", "position")
    cites = rows.select("response_id", "position", "c.chunk_id", F.col("c.exact_quote_context").alias("quote"))
    judged = V.citation_verdicts(cites, _pool(spark, root).select("response_id", "chunk_id", "content", "position"))
    return judged.select("response_id", long("position").alias("position"), "verdict")


_SQL_RESPONSES = f"""{_SQL_CITED},
made AS (
  SELECT doc_id response_id, 0.25 + least(n_chars, 4096) / 8192.0::DOUBLE c0, source = 'src0' d0, CASE WHEN source = 'src0' THEN 'query_out_of_scope' END r0,
    (SELECT count(*) FROM raw_cites r WHERE r.response_id = doc_id) n0 FROM documents),
base AS (
  SELECT response_id, c0, d0 OR c0 < 0.3 d, CASE WHEN NOT d0 AND c0 < 0.3 THEN 'confidence_below_threshold' ELSE r0 END r,
    CASE WHEN NOT d0 AND c0 < 0.3 THEN 0 ELSE n0 END n FROM made)"""


@query("confidence_demote", f"WITH {_SQL_RESPONSES} SELECT response_id, round(c0, 6) confidence, d is_decline, r decline_reason, n::BIGINT n_citations FROM base")
def confidence_demote(spark: SparkSession, root: str) -> DataFrame:
    return _response_summary(V.demote_low_confidence(_responses(spark, root)))


def _response_summary(rows: DataFrame) -> DataFrame:
    return rows.select("response_id", r6("confidence").alias("confidence"), "is_decline", "decline_reason", long(F.size("citations")).alias("n_citations"))


@query(
    "citation_enforce",
    f"""WITH {_SQL_RESPONSES},
    tally AS (SELECT response_id, count(*) FILTER (verdict <> 'valid') bad, count(*) FILTER (verdict = 'valid') good FROM judged GROUP BY response_id),
    checked AS (
      SELECT b.*, NOT d AND bad > 0 touched, NOT d AND bad > 0 AND good = 0 refused, greatest(0, c0 - 0.2::DOUBLE * bad) c1, good FROM base b JOIN tally USING (response_id))
    SELECT response_id, round(CASE WHEN refused THEN 0 WHEN touched THEN c1 ELSE c0 END, 6) confidence,
      d OR refused OR (touched AND c1 < 0.3) is_decline,
      CASE WHEN refused THEN 'no_relevant_context_found' WHEN touched AND c1 < 0.3 THEN 'confidence_below_threshold' ELSE r END decline_reason,
      (CASE WHEN refused OR (touched AND c1 < 0.3) THEN 0 WHEN touched THEN good ELSE n END)::BIGINT n_citations FROM checked""",
)
def citation_enforce(spark: SparkSession, root: str) -> DataFrame:
    made = V.demote_low_confidence(_responses(spark, root))
    pool = _pool(spark, root).select("response_id", "chunk_id", "content", "position")
    return _response_summary(V.enforce_citations(made, pool))


@query(
    "response_rules",
    f"""WITH v AS (SELECT d.doc_id, list_filter([
        CASE WHEN length(substr(text, 1, n_chars::INT - 10)) < 1 THEN 'answer_empty' END,
        CASE WHEN n_chars / 8192.0 > 1 THEN 'confidence_range' END,
        CASE WHEN n_chars > 3000 THEN 'decline_reason_unknown' END,
        CASE WHEN toxic = 1 AND quality = 0 AND n_chars <= 3000 THEN 'decline_reason_missing' END,
        CASE WHEN toxic = 0 AND n_chars < 300 THEN 'citations_missing' END,
        CASE WHEN n_chars >= 300 AND lang = 'es' THEN 'citation_field_missing' END,
        CASE WHEN n_chars >= 300 AND quality = 0 THEN 'citation_page' END,
        CASE WHEN n_chars >= 300 AND (length(quote) < 10 OR {sql_strip("quote")} = '') THEN 'citation_quote' END], lambda x: x IS NOT NULL) v
      FROM (SELECT doc_id, lang, n_chars, text, coalesce(quality, 1) quality, coalesce(toxic, 0) toxic,
          CASE WHEN doc_id % 2 = 0 THEN split_part(text, ' ', 1) ELSE substr(text, 1, 60) END quote
        FROM documents LEFT JOIN labels USING (doc_id)) d)
    SELECT doc_id, array_to_string(v, ',') violations, len(v) = 0 is_valid FROM v""",
)
def response_rules(spark: SparkSession, root: str) -> DataFrame:
    """Documents as responses that break the rules in various ways; those without a label count as good ones."""
    labels = table(spark, root, "labels").select("doc_id", "quality", "toxic")
    rows = documents(spark, root).join(labels, "doc_id", "left")
    rows = rows.withColumn("quality", F.coalesce("quality", F.lit(1))).withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring_index("text", " ", 1)).otherwise(F.substring("text", 1, 60))
    cite = F.struct(
        F.lit("c").alias("chunk_id"), F.when(F.col("lang") != "es", "d").alias("doc_id"), F.col("quality").alias("page_number"),
        quote.alias("exact_quote_context"),
    )
    broken = V.response_violations(
        F.col("lang"),
        F.substring(F.col("text"), F.lit(1), F.greatest(F.col("n_chars") - 10, F.lit(0)).cast("int")),
        F.col("n_chars") / 8192,
        F.col("toxic") == 1,
        F.when(F.col("n_chars") > 3000, "because").when(F.col("quality") == 1, "query_out_of_scope"),
        F.when(F.col("n_chars") >= 300, F.array(cite)).otherwise(F.array_remove(F.array(cite), cite)),
    )
    judged = rows.select("doc_id", broken.alias("v"))
    return judged.select("doc_id", F.array_join("v", ",").alias("violations"), (F.size("v") == 0).alias("is_valid"))


@query(
    "extract_json",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL WHEN event_type = 'view' THEN '{"a": ' || props || '}' ELSE props END AS json FROM events""",
)
def extract_json(spark: SparkSession, root: str) -> DataFrame:
    """Event properties wrapped the way a model wraps its JSON."""
    kind, props = F.col("event_type"), F.col("props")
    text = (
        F.when(kind == "error", F.concat(F.lit("no object: "), F.lit("k}")))
        .when(kind == "signup", F.concat(F.lit("open { "), props))
        .when(kind == "view", F.concat(F.lit('Sure.\n```json\n{"a": '), props, F.lit("}\n```\nDone {x}")))
        .otherwise(F.concat(F.lit("```\n"), props, F.lit("```")))
    )
    return table(spark, root, "events").select("event_id", V.extract_json(text).alias("json"))


@query(
    "json_parse_rate",
    """SELECT event_type, count(*) n, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END n_valid,
      CASE WHEN event_type = 'error' THEN 0 ELSE sum((props->>'$.k')::INT) END::BIGINT sum_k FROM events GROUP BY event_type""",
)
def json_parse_rate(spark: SparkSession, root: str) -> DataFrame:
    """Parse rate per type; properties of errors are cut short first."""
    text = F.when(F.col("event_type") == "error", F.regexp_replace("props", r"\}\z", "")).otherwise(F.col("props"))
    rows = table(spark, root, "events").select("event_type", strict_json(text).alias("v"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("v").alias("n_valid"),
        F.coalesce(F.sum(F.try_variant_get("v", "$.k", "int")), F.lit(0)).alias("sum_k"),
    )


def _raw_text(spark: SparkSession, root: str) -> DataFrame:
    """Model text per document: JSON in a fence, cut short for German ones."""
    own = F.concat(F.col("doc_id").cast("string"), F.lit("::0::0"))
    known = F.struct(own.alias("chunk_id"), F.lit(None).cast("string").alias("section_header"), _cut(40).alias("exact_quote_context"))
    stray = F.struct(F.lit("missing").alias("chunk_id"), F.lit("x").alias("section_header"), F.lit("never retrieved").alias("exact_quote_context"))
    body = F.to_json(
        F.struct(
            F.col("text").alias("answer"), (F.least(F.col("n_chars"), F.lit(8192)) / 6554).alias("confidence"),
            F.lit(False).alias("is_decline"), F.array(known, stray).alias("citations"),
        ),
        {"ignoreNullFields": "false"},
    )
    # Braces inside quotes would end the object early; the texts have none.
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    whole = F.when(F.col("lang") == "de", F.substring(fenced, F.lit(1), F.length(fenced) - 6)).otherwise(fenced)
    return documents(spark, root).select(F.col("doc_id").alias("response_id"), F.col("source").alias("query"), whole.alias("text"))


@query("citation_enrich", f"SELECT doc_id response_id, doc_id::VARCHAR || '::0::0' chunk_id, doc_id::VARCHAR doc_id, NULL::VARCHAR section_header, 1::BIGINT page_number, lang content_type, length({_sql_cut(40)})::BIGINT n_chars, md5({_sql_cut(40)}) digest FROM documents WHERE lang <> 'de'")
def citation_enrich(spark: SparkSession, root: str) -> DataFrame:
    parsed = _raw_text(spark, root).select("response_id", strict_json(V.extract_json(F.col("text"))).alias("v"))
    cites = unfold(parsed, ["response_id"], F.try_variant_get("v", "$.citations", "array<variant>"), "raw", "position")
    out = V.enrich_citations(cites, _pool(spark, root))
    return out.select(
        "response_id", "chunk_id", "doc_id", "section_header", long("page_number").alias("page_number"), "content_type",
        long(F.length("exact_quote_context")).alias("n_chars"), F.md5(F.encode("exact_quote_context", "UTF-8")).alias("digest"),
    )


@query(
    "parse_validate",
    f"""WITH c AS (SELECT doc_id response_id, lang = 'de' bad_json, least(n_chars, 8192) / 6554.0::DOUBLE conf, length({_sql_cut(40)}) < 10 short, length(text) < 1 blank FROM documents),
    v AS (SELECT response_id, conf, CASE WHEN bad_json THEN 'not_json' ELSE concat_ws(',', CASE WHEN blank THEN 'answer_empty' END, CASE WHEN conf > 1 THEN 'confidence_range' END,
      CASE WHEN short THEN 'citation_quote' END) END violations FROM c)
    SELECT response_id, violations, round(CASE WHEN violations <> '' THEN 0 ELSE conf END, 6) confidence, violations <> '' OR conf < 0.3 is_decline,
      CASE WHEN violations <> '' THEN 'no_relevant_context_found' WHEN conf < 0.3 THEN 'confidence_below_threshold' END decline_reason,
      CASE WHEN violations <> '' OR conf < 0.3 THEN 0 ELSE 1 END::BIGINT n_citations FROM v""",
)
def parse_validate(spark: SparkSession, root: str) -> DataFrame:
    out = V.parse_responses(_raw_text(spark, root), _pool(spark, root))
    return out.select(
        "response_id", F.array_join("violations", ",").alias("violations"), r6("confidence").alias("confidence"), "is_decline", "decline_reason",
        long(F.size("citations")).alias("n_citations"),
    )


# Sentences end at white space after a full stop, or at line ends.  The marker
# character stands where the look-behind of the other engine cuts.
SQL_BEST_SENTENCE = f"""
cut AS (
  SELECT query_id, doc_id, rank, {sql_tokens('b.text')} qt,
    string_split_regex(regexp_replace(d.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+') ss
  FROM sparse JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank = 1),
sentences AS (SELECT query_id, doc_id, qt, i, {sql_strip('s')} s FROM (
  SELECT query_id, doc_id, qt, unnest(list_filter(ss, lambda x: length({sql_strip('x')}) >= 10)) s,
    generate_subscripts(list_filter(ss, lambda x: length({sql_strip('x')}) >= 10), 1) i FROM cut)),
rated AS (SELECT *, round(coalesce({sql_share('qt', sql_tokens('s'))}, 0), 9) score FROM sentences),
best AS (SELECT query_id, doc_id, s answer, score FROM rated QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) = 1)"""


@query("extractive_answer", f"WITH {sql_bm25(1)}, {SQL_BEST_SENTENCE} SELECT query_id, doc_id || '::0::0' chunk_id, answer, round(score, 6) confidence FROM best")
def extractive_answer(spark: SparkSession, root: str) -> DataFrame:
    """Best sentence of the best document, quoted as its own source."""
    best = retrieved(spark, root, 1).join(asked(spark, root), "query_id")
    rows = best.select("query_id", "chunk_id", V.best_sentence(F.col("query"), F.col("content")).alias("b"))
    return rows.select("query_id", "chunk_id", F.col("b.text").alias("answer"), r6("b.score").alias("confidence"))
