"""Model slots, scorer switches and the evaluation command."""

import json

import numpy as np
from pyspark.sql import functions as F

from quarrylens import run_evals
from quarrylens.operators import evaluation as E
from quarrylens.operators import models as M


def test_embed_normalizes_prefixed_texts(spark):
    def make_encoder():
        return lambda texts: np.array([[len(t), 0.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("abc",), ("d",)], "t string")
    assert [r.v for r in df.select(M.embed(F.col("t"), make_encoder).alias("v")).collect()] == [[1.0, 0.0], [1.0, 0.0]]


def test_generate_retries_and_never_raises(spark):
    def make_generator():
        calls = {}

        def generator(messages):
            text = messages[0]["content"]
            calls[text] = calls.get(text, 0) + 1
            if text == "broken":
                raise RuntimeError("no model")
            if text == "slow" and calls[text] < 3:
                return " "
            return f"{text} after {calls[text]}"

        return generator

    df = spark.createDataFrame([(i, [(t,)]) for i, t in enumerate(("ok", "slow", "broken"))], "query_id int, messages array<struct<content:string>>")
    rows = M.generate(df, make_generator, wait=lambda seconds: None).orderBy("query_id").collect()
    assert [(r.text, r.error) for r in rows] == [("ok after 1", None), ("slow after 3", None), (None, "no model")]


def test_scorer_switches(spark):
    df = spark.createDataFrame([("q", "a b", "a c", "", False), ("q", "a", "a", "a", True)], "query string, answer string, context string, ground_truth string, is_decline boolean")
    rows = E.score_answers(df).collect()
    assert [(r.faithfulness, r.context_recall, r.error) for r in rows] == [(0.5, None, None), (None, None, "Skipped: decline response")]
    assert {r.error for r in E.score_answers(df, enabled=False).collect()} == {"Scorer disabled"}
    assert json.loads(df.select(E.row_json("query", "answer").alias("j")).first().j) == {"query": "q", "answer": "a b"}


def test_command(spark, tmp_path):
    good = {"query": "when are refunds paid", "context": "Refunds are paid on Monday.", "ground_truth": "monday"}
    bad = {"query": "zebra", "context": "nothing of the kind", "ground_truth": "x"}

    def status(rows, *extra):
        path = tmp_path / "g.jsonl"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return run_evals.run(spark, run_evals.arguments(["--dataset", str(path), *extra]))

    assert status([good, bad], "--output", str(tmp_path / "out")) == 0
    assert spark.read.json(str(tmp_path / "out" / "report")).first().total_triplets == 2
    assert status([bad]) == 1 and status([bad], "--no-gate") == 0
    assert status([bad] * 3 + [good], "--fast") == 1
    assert run_evals.run(spark, run_evals.arguments(["--dataset", str(tmp_path / "absent")])) == 2
