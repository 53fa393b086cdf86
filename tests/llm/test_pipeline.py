"""The stages behind one another, against brute force for what they keep."""

import corpus_pipeline
import pytest
from tests.llm.fixtures import awkward, empty, prose
from tests.llm.test_dedup import brute, brute_lines
from tests.llm.test_rules_and_secrets import base, junk_texts, secret_texts

from quarrylens.llm import quality_rules
from quarrylens.llm.bpe import default_vocabulary, load_bpe


def rows():
    line = "a line of some length that many of the documents share, word for word"
    out = [(k, f"{prose(k, 90)}\n{line}\n{prose(k + 500, 40)}") for k in range(8)]
    out += [(20, prose(3, 90)), (21, prose(3, 90)), (22, None), (23, ""), (None, prose(77)), (24, prose(3, 90) + " token=abcdefgh12345")]
    return out + junk_texts() + secret_texts()[:3]


def test_stages(spark, tmp_path):
    docs = awkward(spark, rows())
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        steps[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    texts = {name: [(r.doc_id, r.text) for r in steps[name]] for name in list(steps)[:-1]}
    kept = {r.doc_id for r in quality_rules.quality_verdicts(awkward(spark, rows())).filter("kept").collect()}
    assert sorted(texts["quality_rules"], key=repr) == sorted(((i, t) for i, t in rows() if i in kept), key=repr)
    assert sorted(texts["line_dedup"], key=repr) == sorted(((i, t) for i, t, _, _ in brute_lines(texts["quality_rules"]).elements()), key=repr)
    comps = brute(texts["line_dedup"])
    want = [(i, t) for i, t in texts["line_dedup"] if i is None or comps[i] == i]
    assert sorted(texts["minhash_dedup"], key=repr) == sorted(want, key=repr)
    assert len(texts["secret_scans"]) == len(want) and not any(base(t) for _, t in texts["secret_scans"])
    bpe = load_bpe(default_vocabulary())
    assert sum(r.length for r in steps["packing"]) == sum(len(bpe.encode(t)) + 1 for _, t in texts["secret_scans"])


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_of_nothing(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, empty(spark), "")
    assert out.count() == 0
