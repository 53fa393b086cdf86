"""Near-dedup, components and line dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import awkward, awkward_texts, empty, prose

from quarrylens.llm import line_dedup, minhash_dedup
from quarrylens.llm.components import components
from quarrylens.llm.cuckoo import CuckooFilter, filter_of, key_words
from quarrylens.llm.minhash_dedup import near_duplicates, spanning_forest
from quarrylens.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWERED))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined_ids(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[:k]
        if x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return joined_ids({i for i, _ in sets}, links)


def edited(text, rate, rng):
    return " ".join(rng.choice(["blue", "tall", "iron"]) + str(rng.randint(0, 9)) if rng.random() < rate else w for w in text.split())


def near_copies():
    rng = random.Random(8)
    rows = awkward_texts()
    for group in range(6):
        text = prose(1000 + group, 200)
        rows += [(100 + 50 * group + k, edited(text, rng.choice([0, 0.01, 0.02, 0.03, 0.05]), rng)) for k in range(25)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark, monkeypatch):
    rows = near_copies()
    want = brute(rows)
    for block, cell in ((1024, 256), (4, 2)):
        # Small blocks put even small buckets on the way of large ones.
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "CELL", cell)
        got = near_duplicates(awkward(spark, rows)).collect()
        assert len(got) == len(rows)
        assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)
        for r in got:
            assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
            assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    left = minhash_dedup.keep_one_of_each(awkward(spark, rows)).collect()
    assert {r.doc_id for r in left} == {i for i, c in want.items() if i == c} | {None}


def test_an_id_on_rows_of_different_texts_beside_unlinked_documents(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        text = prose(2000 + k, 200)
        # The other row of the id shares no band with the documents near the first.
        rows += [(10 * k, text), (10 * k, prose(3000 + k, 200)), (10 * k + 1, edited(text, 0.05, rng)), (10 * k + 2, edited(text, 0.05, rng))]
        rows.append((10 * k + 3, edited(rows[-3][1], 0.01, rng)))
    want = brute(rows)
    assert len(set(want.values())) > 24
    got = near_duplicates(awkward(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


def test_shares_that_the_bands_would_miss_are_refused():
    with pytest.raises(ValueError):
        near_duplicates(None, 50)
    with pytest.raises(ValueError):
        minhash_dedup.keep_one_of_each(None, 74)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).count() == 0
    rows = [(1, None), (2, ""), (3, "  ")]
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(awkward(spark, rows)).collect()} == {(i, 0, i, True) for i in (1, 2, 3)}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + rng.randint(0, 40), 200 + rng.randint(0, 40)) for _ in range(30)]
    links += [(5, 5), (7, 6), (7, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    want = joined_ids({x for e in links for x in e}, links)
    assert got == {x: want[x] for x in ends}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_keeps_what_is_linked():
    rng = np.random.default_rng(1)
    for _ in range(20):
        w = rng.random((15, 15)).astype(np.float32)
        w = np.maximum(w, w.T)
        all_links = [(i, j) for i in range(15) for j in range(i) if w[i, j] >= 0.9]
        assert joined_ids(range(15), all_links) == joined_ids(range(15), spanning_forest(w, 0.9))


def test_hashes_of_long_words_and_many_pieces():
    text = ("x" * 70_000 + " ") * 40 + "tail of it"
    _, hashes = word_hashes(text.encode())
    assert len(hashes) == 43 and len(set(hashes.tolist())) == 4
    whole, again = shingle_sets([text, text])
    assert (whole == again).all()


def brute_lines(rows, least_docs=5):
    def key(line):
        return line.strip(line_dedup.SPACE).translate(LOWERED)

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held[key(x)]) >= least_docs and i < max(held[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def decided(frame):
    return Counter((r[0], r[-3], r[-2], r[-1]) for r in frame.select("doc_id", *frame.columns[-3:]).collect())


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_line_dedup(spark, monkeypatch, shipped):
    monkeypatch.setattr(line_dedup, "SHIPPED_BYTES", shipped)
    done = line_dedup.line_dedup(awkward(spark))
    assert done.columns[:7] == awkward(spark).columns and len(set(done.columns)) == 10
    assert decided(done) == brute_lines(awkward_texts())
    assert sum(n for (_, _, _, gone), n in decided(done).items() if gone) > 0


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_documents_come_and_go(spark):
    rows = [(i, t) for i, t in awkward_texts() if i is not None]
    some, rest = [r for r in rows if r[0] < 12], [r for r in rows if r[0] >= 12]
    first = line_dedup.build_index(awkward(spark, some), shards=3)
    both = line_dedup.insert_documents(first, awkward(spark, rest))
    docs = awkward(spark, rows)
    assert decided(line_dedup.drop_repeated_lines(docs, both)) == brute_lines(rows)
    gone = line_dedup.delete_documents(both, spark.createDataFrame([(i,) for i, _ in rest], "doc_id long"))
    before, after = ({tuple(r) for r in x.counts.collect()} for x in (first, gone))
    assert before == after
    assert decided(line_dedup.drop_repeated_lines(awkward(spark, some), gone)) == brute_lines(some)
    assert sum(r.n_keys for r in gone.filters.collect()) == gone.counts.filter(F.col("n_docs") >= 5).count()


def test_cuckoo_filter():
    rng = random.Random(4)
    keys = [rng.randbytes(16) for _ in range(5000)]
    made = filter_of(keys)
    assert made.contains(key_words(keys)).all()
    others = [rng.randbytes(16) for _ in range(5000)]
    assert made.contains(key_words(others)).mean() < 0.01
    made.delete(key_words(keys[:2500]))
    assert made.contains(key_words(keys[2500:])).all() and made.count == 2500
    assert made.contains(key_words(keys[:2500])).mean() < 0.01
    assert CuckooFilter.of_bytes(made.to_bytes()).count == 2500
    assert not CuckooFilter.sized(1).insert(key_words(keys[:20]))
