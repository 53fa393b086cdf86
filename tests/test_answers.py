"""Prompts, structured answers, citations, evaluation and tickets."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylens.functions.json import strict_json
from quarrylens.operators import evaluation as E
from quarrylens.operators import prompt as P
from quarrylens.operators import sft as S
from quarrylens.operators import validation as V

CHUNK = "query_id int, rank int, chunk_id string, doc_id string, section_header string, page_number int, content_type string, content string"
RESPONSE = f"response_id int, answer string, confidence double, is_decline boolean, decline_reason string, citations array<{V.CITATION_DDL}>"
POOL = "response_id int, chunk_id string, content string, position int"


def cite(chunk, quote):
    return (chunk, "d", None, 1, "prose", quote)


def test_budget_keeps_a_prefix(spark):
    label = len("[CHUNK 1] chunk_id=c | doc=d | section=— | page=1 | type=prose\n")
    rows = [(1, r, "c", "d", None, 1, "prose", "x" * n) for r, n in ((1, 40 - label + 60), (2, 100 - label), (3, 1), (4, 1))]
    rows += [(2, 1, "c", "d", "", 1, "prose", "y" * 5000), (2, 2, "c", "d", "s", 1, "table", "t")]
    kept = P.context_rows(spark.createDataFrame(rows, CHUNK), max_tokens=50).collect()
    # Query 1 fits exactly with two chunks; query 2 keeps only its first.
    assert sorted((r.query_id, r["rank"]) for r in kept) == [(1, 1), (1, 2), (2, 1)]


def test_context_and_messages(spark):
    queries = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id int, query string")
    chunks = spark.createDataFrame([(1, 1, "c1", "d", None, 3, "table", "|a|"), (1, 2, "c2", "d", "S", 1, "prose", "b")], CHUNK)
    contexts = P.context_block(queries, chunks)
    found = {r.query_id: r.context for r in contexts.collect()}
    assert found[1] == (
        "[CHUNK 1] chunk_id=c1 | doc=d | section=— | page=3 | type=table\n```\n|a|\n```\n\n"
        "[CHUNK 2] chunk_id=c2 | doc=d | section=S | page=1 | type=prose\nb"
    )
    assert found[2] == P.NO_CONTEXT
    message = {r.query_id: r.messages for r in P.prompt_messages(contexts, "be brief").collect()}[2]
    assert [m.role for m in message] == ["system", "user"] and message[0].content == "be brief"
    assert P.NO_CONTEXT in message[1].content and "who?" in message[1].content


@pytest.mark.parametrize(
    "text, expected",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('Here: {"a": {"b": 2}} and {"c": 3}', '{"a": {"b": 2}}'),
        ('{"a": 1', None),
        ("none", None),
        ('{"a": "}"}', '{"a": "}'),
        ("} {x}", "{x}"),
        ("", None),
    ],
)
def test_extract_json(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(V.extract_json(F.col("t")).alias("j")).first().j == expected


@pytest.mark.parametrize(
    "text, valid",
    [('{"a":1}', True), ("[1,2]", True), ('{"a":1}}', False), ('{"a":1} x', False), ("1],[2", False), ("1,2", False), ('{"a":1},"b":2', False), ("", False), ("null", True)],
)
def test_strict_json(spark, text, valid):
    v = spark.createDataFrame([(text,)], "t string").select(strict_json(F.col("t")).isNotNull().alias("v")).first().v
    assert v is valid


def test_quotes(spark):
    pool = spark.createDataFrame([(1, "c", "old text", 0), (1, "c", "The  Quick brown\nfox jumps", 1)], POOL)
    quotes = ["quick brown FOX", "   fox   ", "The quick red fox", "quick brown fox", "jumps over it"]
    cites = spark.createDataFrame([(1, i, "c" if i != 3 else "zz", q) for i, q in enumerate(quotes)], "response_id int, position int, chunk_id string, quote string")
    rows = V.citation_verdicts(cites, pool).orderBy("position").collect()
    assert [r.verdict for r in rows] == ["valid", "too_short", "not_verbatim", "unknown_chunk", "not_verbatim"]


def test_enforcement(spark):
    good, bad = cite("c", "valid quote one"), cite("zz", "valid quote one")
    made = spark.createDataFrame(
        [
            (1, "a", 0.9, False, None, [good, good, bad]),
            (2, "a", 0.9, False, None, [bad, bad]),
            (3, "a", 0.45, False, None, [good, bad]),
            (4, "a", 0.9, False, None, [good]),
            (5, "a", 0.0, True, "query_out_of_scope", [bad]),
        ],
        RESPONSE,
    )
    pool = spark.createDataFrame([(i, "c", "some valid quote one here", 0) for i in range(1, 6)], POOL)
    out = {r.response_id: r for r in V.enforce_citations(made, pool).collect()}
    assert abs(out[1].confidence - 0.7) < 1e-9 and len(out[1].citations) == 2 and not out[1].is_decline
    assert (out[2].confidence, out[2].is_decline, out[2].decline_reason, out[2].citations) == (0.0, True, V.NO_CONTEXT, [])
    assert out[2].answer == V.UNVERIFIED_MESSAGE
    assert abs(out[3].confidence - 0.25) < 1e-9 and out[3].decline_reason == V.LOW_CONFIDENCE and out[3].citations == [] and out[3].answer == "a"
    assert out[4].confidence == 0.9 and len(out[4].citations) == 1
    assert out[5].decline_reason == "query_out_of_scope" and len(out[5].citations) == 1
    with pytest.raises(Exception, match="unknown_chunk"):
        V.enforce_citations(made, pool, strict=True).collect()


def test_parse_responses(spark):
    pool = spark.createDataFrame(
        [(i, "c", "content", 0, "d7", "Sec", 0, "table") for i in range(1, 7)],
        POOL + ", doc_id string, section_header string, page_number int, content_type string",
    )
    body = lambda **kw: json.dumps({"answer": "yes", "confidence": 0.8, "citations": [{"chunk_id": "c", "exact_quote_context": "  quoted words "}], **kw})
    raw = spark.createDataFrame(
        [
            (1, "q", body()),
            (2, "q", "no json"),
            (3, "q", body(confidence=1.5)),
            (4, "q", body(citations=[{"chunk_id": "gone", "exact_quote_context": "quoted words"}])),
            (5, "q", body(is_decline=True, citations=[])),
            (6, "q", body(citations=[{"chunk_id": "c", "section_header": None, "page_number": 4, "exact_quote_context": "quoted words"}])),
        ],
        "response_id int, query string, text string",
    )
    out = {r.response_id: r for r in V.parse_responses(raw, pool).collect()}
    assert out[1].violations == [] and out[1].citations[0].asDict() == {
        "chunk_id": "c", "doc_id": "d7", "section_header": "Sec", "page_number": 1, "content_type": "table", "exact_quote_context": "quoted words",
    }
    assert out[2].violations == ["not_json"] and out[2].is_decline
    assert out[3].violations == ["confidence_range"] and out[3].confidence == 0.0
    assert out[4].violations == ["citations_missing"]
    assert out[5].violations == ["decline_reason_missing"]
    # A key that is present wins, an explicit null included.
    assert (out[6].citations[0].section_header, out[6].citations[0].page_number) == (None, 4)


def test_report_and_gate(spark):
    ddl = "response_id int, category string, is_decline boolean, faithfulness double, context_recall double, context_precision double, confidence double, error string"
    rows = [(1, "a", False, 0.9, 0.5, 1.0, 0.8, None), (2, "b", False, 0.8, None, 1.0, 0.6, None), (3, "c", True, None, None, None, 0.0, "boom")]
    results = spark.createDataFrame(rows, ddl)
    report = E.eval_report(results).first()
    assert (report.total_triplets, report.scored_triplets, report.failed_triplets) == (3, 2, 1)
    assert abs(report.avg_faithfulness - 0.85) < 1e-9 and report.passed_gate and report.avg_context_recall == 0.5
    strict = E.gate_verdict(results, require_all_categories=True).first()
    assert strict.failures == ["b"] and not strict.passed
    assert E.gate_verdict(results).first().passed
    # Only declines: nothing scored, the gate fails at zero.
    declines = results.filter("is_decline")
    assert E.gate_verdict(declines).first().failures == ["overall"] and E.eval_report(declines).first().avg_faithfulness == 0.0
    assert E.eval_report(results.filter("false")).first().decline_rate is None
    assert E.category_breakdown(results).count() == 2
    assert E.first_triplets(results, "response_id", 2).count() == 2 and E.first_triplets(results, "response_id").count() == 3


def test_triplets(spark):
    rows = [(1, "when are refunds paid", "We sell shoes here. Refunds are paid on Monday.", "refunds monday"), (2, "zebra", "nothing about it at all", "")]
    out = {r.response_id: r for r in E.evaluate_triplets(spark.createDataFrame(rows, "response_id int, query string, context string, ground_truth string")).collect()}
    assert out[1].generated_answer == "Refunds are paid on Monday." and out[1].faithfulness == 1.0 and out[1].context_recall == 1.0
    assert out[2].is_decline and out[2].faithfulness is None and out[2].category == "unknown"


def test_tickets(spark):
    truth = ("S1", "RTO", None, 100.0, "HIGH", "refund")
    good = {"supplier_id": "S1", "issue_type": "RTO", "order_id": None, "amount_disputed": 101.0, "priority": "HIGH", "resolution_requested": "refund"}
    cases = [
        json.dumps(good), json.dumps({**good, "amount_disputed": 101.1}), json.dumps({**good, "amount_disputed": "abc"}), "{}", "[1]", "nonsense",
        json.dumps({**good, "amount_disputed": "100"}), json.dumps({**good, "supplier_id": 1, "priority": True}),
    ]
    ddl = "i int, p string, t struct<supplier_id:string,issue_type:string,order_id:string,amount_disputed:double,priority:string,resolution_requested:string>"
    rows = S.ticket_scores(spark.createDataFrame([(i, c, truth) for i, c in enumerate(cases)], ddl), "p", "t").orderBy("i").collect()
    # An absent order id equals the null one.
    assert [r.n_correct for r in rows] == [6, 5, 5, 1, 0, 0, 6, 4]
    assert [r.json_valid for r in rows] == [True, True, True, True, False, False, True, True]
    assert [r.amount_correct for r in rows] == [True, False, False, False, False, False, True, True]
    pairs = spark.createDataFrame([(None, None), (None, 1.0), (0.5, 0.509)], "p double, t double")
    both = pairs.select(S.amount_match(F.col("p"), F.col("t")).alias("m"), S.amount_close(F.col("p"), F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in both] == [(True, False), (False, False), (True, True)]


@pytest.mark.parametrize("n", [1, 7, 10, 101])
def test_split_sizes_are_exact(spark, n):
    split = S.exact_split(spark.range(n), "id")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts.get("train", 0) == int(n * 0.9) and sum(counts.values()) == n
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, S.exact_split(spark.range(n).repartition(3), "id").collect()))


def test_split_with_equal_digests(spark, monkeypatch):
    monkeypatch.setattr(S, "order_key", lambda ident, seed=42: (ident % 2).cast("long"))
    split = S.exact_split(spark.range(10), "id", 0.7).collect()
    assert sorted(r.id for r in split if r.split == "train") == [0, 1, 2, 3, 4, 6, 8]


def test_synthetic_pairs(spark):
    rows = S.synthetic_pairs(spark.range(500), "id").collect()
    again = S.synthetic_pairs(spark.range(500).repartition(7), "id").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for r in rows:
        assert "{" not in r.log and r.ticket.supplier_id in r.log
        assert (r.ticket.order_id is None) == ("ORD-" not in r.log)
    assert {r.ticket.issue_type for r in rows} == {issue[0] for issue in S.ISSUES}


def test_chatml(spark):
    ticket = F.struct(F.lit("é").alias("ticket_id"), F.lit(None).cast("string").alias("order_id"))
    m = spark.range(1).select(S.chatml(F.lit("log"), S.ticket_to_json(ticket), "sys").alias("m")).first().m
    assert [x.role for x in m] == ["system", "user", "assistant"] and m[2].content == '{"ticket_id":"é","order_id":null}'
    df = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    row = df.select(S.first_with_role(F.col("m"), "nobody").alias("x"), F.size(S.without_role(F.col("m"), "assistant")).alias("n"), S.chat_template(F.col("m")).alias("t")).first()
    assert row.x is None and row.n == 2 and row.t.startswith("<|im_start|>system\nsys<|im_end|>\n")


def test_triplets_through_the_slots(spark, tmp_path):
    import json

    from quarrylens.operators import evaluation as E

    calls = str(tmp_path / "calls")

    def make_generator():
        def generate(messages):
            user = messages[1]["content"]
            with open(calls, "a", encoding="utf-8") as log:
                log.write("x")
            if "broken" in user:
                raise RuntimeError("model is down")
            if "unquoted" in user:
                return json.dumps({"answer": "made up", "confidence": 0.9, "citations": [{"chunk_id": "d1::eval::0", "exact_quote_context": "words that nobody wrote"}]})
            chunk = user.split("chunk_id=")[1].split(" ")[0]
            return json.dumps({"answer": "Refunds are paid on Monday.", "confidence": 0.9, "citations": [{"chunk_id": chunk, "exact_quote_context": "refunds are  paid on Monday"}]})

        return generate

    context = "Refunds are paid on Monday. Other things follow {later}."
    rows = [(1, "when are refunds paid", context, "paid on Monday", "d1"), (2, "broken question", context, "", "d1"), (3, "unquoted question", context, "Monday", "d1")]
    triplets = spark.createDataFrame(rows, "response_id long, query string, context string, ground_truth string, doc_id string")
    out = E.evaluate_through(triplets, make_generator, wait=lambda seconds: None)
    got = {r.response_id: r for r in out.collect()}
    assert (got[1].is_decline, got[1].faithfulness, got[1].context_recall, got[1].context_precision, got[1].error) == (False, 1.0, 1.0, 1.0, None)
    assert (got[2].is_decline, got[2].faithfulness, got[2].error) == (True, None, "model is down")
    assert (got[3].is_decline, got[3].error) == (True, None) and all(r.latency_ms >= 0 for r in got.values())
    report = E.eval_report(out).first()
    assert (report.total_triplets, report.scored_triplets, report.failed_triplets) == (3, 1, 1) and report.avg_latency_ms >= 0
    # One call for each triplet, three attempts for the broken one, whatever is read.
    assert len(open(calls, encoding="utf-8").read()) == 5
