"""Queries over evaluation results and fine-tuning data."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import evaluation as E
from quarrylens.operators import sft as S
from quarrylens.plans.catalog import documents, long, query, r6, rows_of, sql_share, sql_strip, sql_tokens, table
from quarrylens.operators.prompt import USER_TEMPLATE
from quarrylens.operators.sizing import fetch_by_key
from quarrylens.operators.validation import DECLINE_MESSAGE
from quarrylens.plans.answer_queries import SQL_BEST_SENTENCE
from quarrylens.plans.retrieval_queries import bm25_hits, sql_bm25
from quarrylens.session import shared_dir
from quarrylens.sources.tables import read_jsonl, write_jsonl


def _results(spark: SparkSession, root: str) -> DataFrame:
    """All documents as evaluation rows: toxic ones declined, these and unlabelled ones unscored."""
    rows = documents(spark, root).join(table(spark, root, "labels"), "doc_id", "left")
    scored = F.col("toxic") == 0
    return rows.select(
        F.col("doc_id").alias("response_id"),
        F.col("lang").alias("category"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_decline"),
        F.when(scored, 0.5 + F.col("quality") * 0.25 + F.least(F.col("n_chars"), F.lit(2048)) / 8192).alias("faithfulness"),
        F.when(scored & (F.col("quality") == 1), F.least(F.col("n_chars"), F.lit(1024)) / 1024).alias("context_recall"),
        F.when(scored, F.col("quality").cast("double")).alias("context_precision"),
        (F.least(F.col("n_chars"), F.lit(4096)) / 4096).alias("confidence"),
        F.when(F.col("n_chars") < 200, "too short").alias("error"),
    )


_SQL_RESULTS = """results AS (
  SELECT doc_id response_id, lang category, coalesce(toxic = 1, false) is_decline,
    CASE WHEN toxic = 0 THEN 0.5::DOUBLE + quality * 0.25::DOUBLE + least(n_chars, 2048) / 8192.0::DOUBLE END faithfulness,
    CASE WHEN toxic = 0 AND quality = 1 THEN least(n_chars, 1024) / 1024.0::DOUBLE END context_recall,
    CASE WHEN toxic = 0 THEN quality::DOUBLE END context_precision, least(n_chars, 4096) / 4096.0::DOUBLE confidence,
    CASE WHEN n_chars < 200 THEN 'too short' END error
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query("row_gate", f"WITH {_SQL_RESULTS} SELECT response_id, coalesce(faithfulness >= 0.85, false) passed FROM results")
def row_gate(spark: SparkSession, root: str) -> DataFrame:
    return _results(spark, root).select("response_id", E.passes(F.col("faithfulness")).alias("passed"))


@query(
    "eval_report",
    f"""WITH {_SQL_RESULTS} SELECT count(*) total_triplets, count(faithfulness) scored_triplets, count(error) failed_triplets,
      round(coalesce(avg(faithfulness), 0), 6) avg_faithfulness, round(coalesce(avg(context_recall), 0), 6) avg_context_recall,
      round(coalesce(avg(context_precision), 0), 6) avg_context_precision, round(avg(is_decline::INT), 6) decline_rate, round(avg(confidence), 6) avg_confidence,
      0.85::DOUBLE faithfulness_gate_threshold, coalesce(avg(faithfulness), 0) >= 0.85 passed_gate FROM results""",
)
def eval_report(spark: SparkSession, root: str) -> DataFrame:
    report = E.eval_report(_results(spark, root))
    rounded = ("avg_faithfulness", "avg_context_recall", "avg_context_precision", "decline_rate", "avg_confidence")
    return report.select(*[r6(c).alias(c) if c in rounded else F.col(c) for c in report.columns])


@query(
    "category_breakdown",
    f"WITH {_SQL_RESULTS} SELECT category, round(avg(faithfulness), 6) avg_faithfulness, count(*) num_triplets, avg(faithfulness) >= 0.85 passed FROM results WHERE faithfulness IS NOT NULL GROUP BY category",
)
def category_breakdown(spark: SparkSession, root: str) -> DataFrame:
    return E.category_breakdown(_results(spark, root)).withColumn("avg_faithfulness", r6("avg_faithfulness"))


@query(
    "gate_verdict",
    f"""WITH {_SQL_RESULTS}, levels AS (
      SELECT 0 AS level, 'overall' scope, avg(faithfulness) m FROM results UNION ALL
      SELECT 1, category, avg(faithfulness) FROM results GROUP BY category HAVING count(faithfulness) > 0)
    SELECT round((SELECT m FROM levels WHERE level = 0), 6) avg_faithfulness, 0.85::DOUBLE threshold,
      coalesce(string_agg(scope, ',' ORDER BY level, scope) FILTER (coalesce(m, 0) < 0.85), '') failures,
      count(*) FILTER (coalesce(m, 0) < 0.85) = 0 passed FROM levels""",
)
def gate_verdict(spark: SparkSession, root: str) -> DataFrame:
    verdict = E.gate_verdict(_results(spark, root), require_all_categories=True)
    return verdict.select(r6("avg_faithfulness").alias("avg_faithfulness"), "threshold", F.array_join("failures", ",").alias("failures"), "passed")


def _answer_pairs(spark: SparkSession, root: str, k: int = 5) -> DataFrame:
    """Every benchmark text with the contents retrieved for it."""
    asked = table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = documents(spark, root).select("doc_id", F.col("text").alias("content"))
    return fetch_by_key(bm25_hits(spark, root, k).join(asked, "query_id"), docs, "doc_id")


_SQL_PAIRS = f"""{sql_bm25(5)},
pairs AS (SELECT query_id, doc_id, rank, d.toks c, q.t q FROM sparse JOIN toks d USING (doc_id) JOIN (SELECT item_id query_id, {sql_tokens('text')} t FROM benchmark) q USING (query_id))"""


@query("lexical_faithfulness", f"WITH {_SQL_PAIRS} SELECT query_id, rank, round({sql_share('q', 'c')}, 6) score FROM pairs")
def lexical_faithfulness(spark: SparkSession, root: str) -> DataFrame:
    score = E.lexical_faithfulness(F.col("query"), F.col("content"))
    return _answer_pairs(spark, root).select("query_id", long("rank").alias("rank"), r6(score).alias("score"))


@query("lexical_recall", f"WITH {_SQL_PAIRS} SELECT query_id, rank, round({sql_share('c', 'q')}, 6) score FROM pairs")
def lexical_recall(spark: SparkSession, root: str) -> DataFrame:
    """The document as the truth: how much of it the query text covers."""
    score = E.lexical_recall(F.col("content"), F.col("query"))
    return _answer_pairs(spark, root).select("query_id", long("rank").alias("rank"), r6(score).alias("score"))


@query(
    "context_precision",
    f"""WITH {_SQL_PAIRS}, hit AS (SELECT query_id, rank, (coalesce({sql_share('q', 'c')}, 0) >= 0.5)::INT h FROM pairs),
    seen AS (SELECT *, sum(h) OVER (PARTITION BY query_id ORDER BY rank) n FROM hit)
    SELECT query_id, round(avg(n / rank::DOUBLE) FILTER (h = 1), 6) context_precision FROM seen GROUP BY query_id""",
)
def context_precision(spark: SparkSession, root: str) -> DataFrame:
    share = F.coalesce(E.lexical_recall(F.col("query"), F.col("content")), F.lit(0.0))
    out = E.context_precision(_answer_pairs(spark, root), share >= E.RELEVANT_SHARE)
    return out.select("query_id", r6("context_precision").alias("context_precision"))


@query(
    "triplet_eval",
    f"""WITH {sql_bm25(1)}, {SQL_BEST_SENTENCE},
    made AS (SELECT query_id, doc_id, q.text query, q.t qt, d.toks ct, b.answer, b.score, coalesce(b.score, 0) >= 0.3 live
      FROM sparse JOIN toks d USING (doc_id) JOIN (SELECT item_id query_id, text, {sql_tokens('text')} t FROM benchmark) q USING (query_id) LEFT JOIN best b USING (query_id))
    SELECT query_id response_id, query, query ground_truth, CASE WHEN coalesce(score, 0) > 0 THEN answer ELSE '{DECLINE_MESSAGE}' END generated_answer,
      NOT live is_decline, round(coalesce(score, 0), 6) confidence, CASE WHEN live THEN round({sql_share(sql_tokens('answer'), 'ct')}, 6) END faithfulness,
      CASE WHEN live THEN round({sql_share('qt', 'ct')}, 6) END context_recall, CASE WHEN live THEN ({sql_share('qt', 'ct')} >= 0.5)::INT::DOUBLE END context_precision,
      doc_id::VARCHAR doc_id, 'unknown' category, 'unknown' difficulty, NULL::VARCHAR error FROM made""",
)
def triplet_eval(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark texts as golden queries over their best documents."""
    best = _answer_pairs(spark, root, 1)
    triplets = best.select(
        F.col("query_id").alias("response_id"), "query", F.col("content").alias("context"), F.col("query").alias("ground_truth"), "doc_id"
    )
    out = E.evaluate_triplets(triplets)
    rounded = ("confidence", "faithfulness", "context_recall", "context_precision")
    return out.select(*[r6(c).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query(
    "row_json",
    """SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'quality': quality, 'toxic': toxic})::VARCHAR AS record
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def row_json(spark: SparkSession, root: str) -> DataFrame:
    """Every document's record as JSON; what is missing is written as null."""
    labels = table(spark, root, "labels").select("doc_id", "quality", "toxic")
    rows = documents(spark, root).select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return rows.select("doc_id", E.row_json("doc_id", "lang", "n_chars", "quality", "toxic").alias("record"))


_HEAD, _MIDDLE, _ = USER_TEMPLATE


def quoting_generator() -> Callable[[Sequence[dict]], str]:
    """A scripted model: answers with the start of its chunk; fails on some queries and forgets its JSON on others."""

    def generate(messages: Sequence[dict]) -> str:
        user = messages[1]["content"]
        cut = user.rindex(_MIDDLE)
        label, content = user[len(_HEAD) : cut].split("\n", 1)
        asked = len(user) - cut
        if asked % 7 == 0:
            raise ConnectionError("no answer")
        quote = content[:60].strip()
        if asked % 5 == 0:
            return quote
        chunk = label.split("chunk_id=", 1)[1].split(" | ", 1)[0]
        return json.dumps({"answer": quote, "confidence": 0.75, "citations": [{"chunk_id": chunk, "exact_quote_context": quote}]})

    return generate


_FRAME = len(USER_TEMPLATE[1]) + len(USER_TEMPLATE[2])


@query(
    "triplet_generation",
    f"""WITH {sql_bm25(1)},
    made AS (SELECT query_id, doc_id, {sql_strip('substr(x.text, 1, 60)')} answer, q.t qt, d.toks ct, (length(q.text) + {_FRAME}) % 7 = 0 broken, (length(q.text) + {_FRAME}) % 5 = 0 bare
      FROM sparse JOIN toks d USING (doc_id) JOIN documents x USING (doc_id) JOIN (SELECT item_id query_id, text, {sql_tokens('text')} t FROM benchmark) q USING (query_id)),
    judged AS (SELECT *, NOT broken AND NOT bare AND length(answer) >= 10 live FROM made)
    SELECT query_id response_id, CASE WHEN live THEN answer ELSE '{DECLINE_MESSAGE}' END generated_answer, NOT live is_decline, CASE WHEN live THEN 0.75 ELSE 0 END::DOUBLE confidence,
      CASE WHEN live THEN round({sql_share(sql_tokens('answer'), 'ct')}, 6) END faithfulness, CASE WHEN live THEN round({sql_share('qt', 'ct')}, 6) END context_recall,
      CASE WHEN live THEN ({sql_share('qt', 'ct')} >= 0.5)::INT::DOUBLE END context_precision, CASE WHEN broken THEN 'no answer' END error, true measured FROM judged""",
)
def triplet_generation(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark texts over their best documents, through prompt, model, parser, citation check and scorers."""
    best = _answer_pairs(spark, root, 1)
    triplets = best.select(F.col("query_id").alias("response_id"), "query", F.col("content").alias("context"), F.col("query").alias("ground_truth"), "doc_id")
    out = E.evaluate_through(triplets, quoting_generator, wait=lambda seconds: None)
    return out.select(
        "response_id", "generated_answer", "is_decline", "confidence", r6("faithfulness").alias("faithfulness"), r6("context_recall").alias("context_recall"),
        "context_precision", "error", (F.col("latency_ms") >= 0).alias("measured"),
    )


# Fine-tuning data -----------------------------------------------------------

_SQL_SYSTEM = "'" + S.SYSTEM_PROMPT.replace("'", "''") + "'"
_SQL_PAIRED = f"""
  sys AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') sys, bool_or(role IN ('user', 'assistant')) talks FROM conversations GROUP BY conv_id),
  met AS (SELECT coalesce(u.conv_id, a.conv_id) conv_id, coalesce(u.turn, a.turn - 1) turn, u.text asked, a.text reply, u.conv_id IS NOT NULL asks, a.conv_id IS NOT NULL replies
    FROM (SELECT * FROM conversations WHERE role = 'user') u FULL JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
  turns AS (SELECT conv_id, turn, coalesce(sys, {_SQL_SYSTEM}) sys, asked, reply, asks, replies FROM met JOIN sys USING (conv_id)
    UNION ALL SELECT conv_id, NULL, sys, NULL, NULL, false, false FROM sys WHERE NOT talks AND sys IS NOT NULL)"""


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return S.turn_pairs(table(spark, root, "conversations"), "conv_id", "turn")


@query(
    "chatml_pack",
    f"""WITH {_SQL_PAIRED} SELECT conv_id, turn, (1 + asks::INT + replies::INT)::BIGINT n_messages,
    md5(sys || CASE WHEN asks THEN '|' || asked ELSE '' END || CASE WHEN replies THEN '|' || reply ELSE '' END) digest FROM turns""",
)
def chatml_pack(spark: SparkSession, root: str) -> DataFrame:
    joined = F.array_join(F.transform("messages", lambda m: m["content"]), "|")
    return _pairs(spark, root).select(
        "conv_id", "turn", long(F.size("messages")).alias("n_messages"), F.md5(F.encode(joined, "UTF-8")).alias("digest")
    )


@query("role_pick", f"WITH {_SQL_PAIRED} SELECT conv_id, turn, asked user_text, reply assistant_text, (1 + asks::INT)::BIGINT n_prompt FROM turns")
def role_pick(spark: SparkSession, root: str) -> DataFrame:
    messages = F.col("messages")
    return _pairs(spark, root).select(
        "conv_id", "turn", S.first_with_role(messages, "user").alias("user_text"), S.first_with_role(messages, "assistant").alias("assistant_text"),
        long(F.size(S.without_role(messages, "assistant"))).alias("n_prompt"),
    )


_SQL_CHAT = " || ".join(
    f"CASE WHEN {there} THEN '<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>' || chr(10) ELSE '' END"
    for role, text, there in (("system", "sys", "true"), ("user", "asked", "asks"), ("assistant", "reply", "replies"))
)


@query("chat_template", f"WITH {_SQL_PAIRED} SELECT conv_id, turn, md5({_SQL_CHAT}) digest, length({_SQL_CHAT})::BIGINT n_chars FROM turns")
def chat_template(spark: SparkSession, root: str) -> DataFrame:
    rows = _pairs(spark, root).select("conv_id", "turn", S.chat_template(F.col("messages")).alias("t"))
    return rows.select("conv_id", "turn", F.md5(F.encode("t", "UTF-8")).alias("digest"), long(F.length("t")).alias("n_chars"))


@query(
    "sft_split",
    """WITH c AS (SELECT DISTINCT conv_id FROM conversations),
    o AS (SELECT conv_id, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || conv_id), 1, 13))::BIGINT, conv_id) r, count(*) OVER () n FROM c)
    SELECT conv_id, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'eval' END split FROM o""",
)
def sft_split(spark: SparkSession, root: str) -> DataFrame:
    return S.exact_split(table(spark, root, "conversations").select("conv_id").distinct(), "conv_id")


def _tickets(spark: SparkSession, root: str) -> DataFrame:
    """Orders as true tickets, and two models' texts predicting them."""
    orders = rows_of(spark, root, "orders")
    truth = F.struct(
        F.col("o_custkey").cast("string").alias("supplier_id"), F.col("o_orderpriority").alias("issue_type"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("order_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("amount_disputed"),
        F.col("o_orderstatus").alias("priority"), F.lit("refund").alias("resolution_requested"),
    )

    def predicted(model: str, factor: float):  # noqa: ANN202
        body = F.to_json(
            F.struct(
                F.col("o_custkey").cast("string").alias("supplier_id"), F.col("o_orderpriority").alias("issue_type"),
                F.col("o_orderkey").cast("string").alias("order_id"),
                F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") * factor).alias("amount_disputed"),
                F.when(F.col("o_orderstatus") == "O", "O").otherwise("MEDIUM").alias("priority"), F.lit("refund").alias("resolution_requested"),
            ),
            {"ignoreNullFields": "false"},
        )
        text = F.when((F.col("o_orderstatus") == "P") & F.lit(model == "base"), F.concat(body, F.lit("}"))).otherwise(body)
        return F.struct(F.lit(model).alias("model"), text.alias("predicted"))

    both = F.explode(F.array(predicted("base", 1.02), predicted("tuned", 1.005)))
    rows = orders.select("o_orderkey", truth.alias("truth"), both.alias("m"))
    return rows.select("o_orderkey", "truth", "m.model", "m.predicted")


_SQL_TICKETS = """m AS (SELECT * FROM (VALUES ('base', false), ('tuned', true)) v(model, close)),
scored AS (
  SELECT o_orderkey, model, NOT (o_orderstatus = 'P' AND model = 'base') json_valid, o_orderpriority <> '5-LOW' has_amount, close,
    3 + (o_orderstatus <> 'F')::INT + (o_orderstatus = 'O')::INT + (o_orderpriority <> '5-LOW' AND close)::INT hits
  FROM orders, m),
tickets AS (
  SELECT o_orderkey, model, json_valid, CASE WHEN json_valid THEN hits ELSE 0 END::BIGINT n_correct, json_valid issue_type_correct,
    json_valid AND (NOT has_amount OR close) amount_correct, CASE WHEN json_valid THEN hits ELSE 0 END / 6.0::DOUBLE accuracy FROM scored)"""


@query(
    "ticket_score",
    f"WITH {_SQL_TICKETS} SELECT o_orderkey, model, json_valid, n_correct, issue_type_correct, amount_correct, round(accuracy, 6) field_accuracy FROM tickets",
)
def ticket_score(spark: SparkSession, root: str) -> DataFrame:
    rows = S.ticket_scores(_tickets(spark, root), "predicted", "truth")
    return rows.select("o_orderkey", "model", "json_valid", long("n_correct").alias("n_correct"), "issue_type_correct", "amount_correct", r6("field_accuracy").alias("field_accuracy"))


@query(
    "amount_match",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN l_linestatus <> 'O'
      ELSE l_linestatus = 'O' AND l_discount < 0.035 END loose, l_returnflag <> 'R' AND l_linestatus = 'O' AND l_discount < 0.035 strict FROM lineitem""",
)
def amount_match(spark: SparkSession, root: str) -> DataFrame:
    """Prices less a third of their discount as predictions, under both amount rules."""
    truth = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    predicted = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") * (1 - F.col("l_discount") * 0.3))
    return table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", S.amount_match(predicted, truth).alias("loose"), S.amount_close(predicted, truth).alias("strict")
    )


_SQL_MODELS = f"""WITH {_SQL_TICKETS}, models AS (
  SELECT model, avg(accuracy) a, avg(json_valid::INT) j, count(*) n FROM tickets GROUP BY model)"""


@query("model_score", f"{_SQL_MODELS} SELECT model, round(a, 6) avg_field_accuracy, round(j, 6) json_parse_rate, n n_samples FROM models")
def model_score(spark: SparkSession, root: str) -> DataFrame:
    scores = S.model_scores(S.ticket_scores(_tickets(spark, root), "predicted", "truth"))
    return scores.select("model", r6("avg_field_accuracy").alias("avg_field_accuracy"), r6("json_parse_rate").alias("json_parse_rate"), "n_samples")


@query(
    "model_compare",
    f"{_SQL_MODELS} SELECT round(t.a - b.a, 6) accuracy_delta, round(t.j - b.j, 6) json_rate_delta, t.a - b.a > 0 improved, t.n n_samples FROM models b, models t WHERE b.model = 'base' AND t.model = 'tuned'",
)
def model_compare(spark: SparkSession, root: str) -> DataFrame:
    scores = S.model_scores(S.ticket_scores(_tickets(spark, root), "predicted", "truth"))
    out = S.model_comparison(scores, "base", "tuned")
    return out.select(r6("accuracy_delta").alias("accuracy_delta"), r6("json_rate_delta").alias("json_rate_delta"), "improved", "n_samples")


def _sql_draw(salt: str, n: int) -> str:
    return f"(('0x' || substr(md5('42:' || o_orderkey || ':{salt}'), 1, 13))::BIGINT % {n})"


def _sql_at(values: tuple, index: str) -> str:
    spelled = ("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{', '.join(spelled)}][{index} + 1]"


_ISSUE = [_sql_at(tuple(row[i] for row in S.ISSUES), "issue") for i in range(6)]
_SLOTS = {
    "topic": _sql_at(S.TOPICS, "issue"), "sid": "sid", "amt": "amt::VARCHAR", "oid": f"CASE WHEN {_ISSUE[4]} THEN oid END",
    "agent": f"CASE WHEN {_ISSUE[5]} THEN agent END", "hint": f"lower(coalesce({_ISSUE[3]}, prio))",
}
_SQL_LOG = "concat_ws(' ', " + ", ".join(f"replace('{S.PHRASES[name]}', '{{}}', {value})" for name, value in _SLOTS.items()) + ")"


@query(
    "synthetic_pairs",
    f"""WITH d AS (SELECT o_orderkey, {_sql_draw('issue', len(S.ISSUES))} issue, {_sql_at(S.PRIORITIES, _sql_draw('priority', len(S.PRIORITIES)))} prio,
      ({_sql_draw('supplier', 90000)} + 10000)::VARCHAR sid, 'ORD-' || ({_sql_draw('order', 9000000)} + 1000000) oid, {_sql_draw('amount', 4951)} + 50 amt,
      {_sql_at(S.AGENTS, _sql_draw('agent', len(S.AGENTS)))} agent FROM orders)
    SELECT o_orderkey, {_SQL_LOG} log, 'TKT-' || (o_orderkey + 1000) ticket_id, {_ISSUE[0]} issue_type, CASE WHEN {_ISSUE[4]} THEN oid END order_id,
      amt::DOUBLE amount_disputed, coalesce({_ISSUE[3]}, prio) priority, CASE WHEN {_ISSUE[5]} THEN agent END assigned_agent, {_ISSUE[2]}::BOOLEAN item_returned FROM d""",
)
def synthetic_pairs(spark: SparkSession, root: str) -> DataFrame:
    """A support log and ticket for every order."""
    rows = S.synthetic_pairs(rows_of(spark, root, "orders"), "o_orderkey")
    fields = ("ticket_id", "issue_type", "order_id", "amount_disputed", "priority", "assigned_agent", "item_returned")
    read_back = F.from_json(S.ticket_to_json(F.col("ticket")), S.TICKET_DDL)
    return rows.select("o_orderkey", "log", read_back.alias("t")).select("o_orderkey", "log", *[f"t.{name}" for name in fields])


@query("jsonl_roundtrip", "SELECT doc_id, md5(text) digest, lang FROM documents")
def jsonl_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    folder = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(documents(spark, root).select("doc_id", "text", "lang"), folder)
    rows = read_jsonl(spark, folder, "doc_id long, text string, lang string")
    return rows.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), "lang")
