"""Language-model scores and nearest neighbours."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import awkward, awkward_texts, empty, prose

from quarrylens.llm import hilbert_ann, pitman_yor
from quarrylens.llm.pitman_yor import Root, packed, packed_counts, seat_pairs, unpacked, unpacked_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.lower() if w.isascii() else w for w in WORD.findall(text or "")] + [None]


def corpus():
    return [r for r in awkward_texts() if r[0] != 32] + [(400 + k, prose(k % 40, 60)) for k in range(120)]


def test_scores(spark):
    rows = corpus()
    got = pitman_yor.score_documents(awkward(spark, rows)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    by = {r.held_out: r for r in pitman_yor.perplexity(spark.createDataFrame(got)).collect()}
    assert by[True].perplexity < by[True].base_perplexity and by[False].perplexity < by[False].base_perplexity
    again = pitman_yor.score_documents(awkward(spark, rows).repartition(2)).collect()
    assert sorted(round(r.score, 6) for r in again) == sorted(round(r.score, 6) for r in got)


def test_nothing_to_learn_from(spark):
    assert pitman_yor.score_documents(empty(spark)).count() == 0
    (row,) = pitman_yor.score_documents(awkward(spark, [(None, "only held out")])).collect()
    assert row.held_out and (row.n_tokens, row.n_known, row.train_tokens) == (4, 0, 0) and math.isfinite(row.score)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = awkward(spark, corpus()).select("text")
    model = pitman_yor.train(docs)
    width = len(model.symbols.words) + 2
    pairs = {}
    for row in model.pairs.join(model.seats, "shard").collect():
        for k, n, *t in zip(unpacked(bytes(row["keys"])).tolist(), unpacked_counts(bytes(row["counts"])), *[unpacked_counts(bytes(row[f"t{s}"])) for s in range(len(model.roots))]):
            assert all(1 <= x <= n for x in t)
            pairs[k] = (n, *t)
    for context in (0, 5, model.symbols.rare, model.symbols.start):
        keys = np.array([(context << 21) | w for w in range(width - 1)], dtype=np.uint64)
        rows = [pairs.get(k, (0,) * (1 + len(model.roots))) for k in keys.tolist()]
        counts, *tables = (np.array(x, dtype=float) for x in zip(*rows))
        logs = pitman_yor.pair_scores(keys, counts, tables, (model.discount, model.totals, model.roots))
        assert abs((10**logs).sum() - 1) < 1e-9


def seating_law(customers, rate, discount):
    """Chances of each number of tables for one dish alone in a restaurant, by enumeration."""
    chances = {(): 1.0}
    for _ in range(customers):
        grown = Counter()
        for tables, p in chances.items():
            grown[(*tables, 1)] += p * (pitman_yor.STRENGTH + discount * len(tables)) * rate
            for k, n in enumerate(tables):
                grown[(*tables[:k], n + 1, *tables[k + 1 :])] += p * (n - discount)
        chances = grown
    law = Counter()
    for tables, p in chances.items():
        law[len(tables)] += p
    total = sum(law.values())
    return {t: p / total for t, p in law.items()}


def test_gibbs_reaches_the_seating_law():
    many, discount, customers, rate = 4000, 0.6, 4, 0.3
    # One context each, so that every restaurant holds one dish.
    keys = (np.arange(many, dtype=np.uint64) << np.uint64(21)) | np.uint64(0)
    root = Root(np.ones(many), np.full(1, 1e12), np.full(1, rate))
    tables = seat_pairs(keys, np.full(many, customers), np.ones(many, np.int64), root, discount, 60, [3])
    law = seating_law(customers, rate, discount)
    for t, p in law.items():
        assert abs((tables == t).mean() - p) < 0.04


def summed_seating_law(customers, rate, discount):
    """The same chances with the customers of the tables summed out: they leave what the discount leaves."""
    law = [0.0, 1.0] + [0.0] * customers
    for seated in range(1, customers):
        opened = [0.0] + [p * (pitman_yor.STRENGTH + discount * t) * rate for t, p in enumerate(law[:-1])]
        law = [p * max(0.0, seated - discount * t) + q for t, (p, q) in enumerate(zip(law, opened))]
        total = sum(law)
        law = [p / total for p in law]
    return np.array(law[: customers + 1])


def production_tables(customers, rate, discount, many=3000):
    """Tables of one dish alone in each of many restaurants, after every kept round."""
    keys = np.arange(many, dtype=np.uint64) << np.uint64(21)
    tables, kept = np.ones(many, np.int64), []
    for turn in range(pitman_yor.ROUNDS):
        root = Root(tables.astype(float), np.full(1, 1e12), np.full(1, rate))
        tables = seat_pairs(keys, np.full(many, customers), tables, root, discount, pitman_yor.STEPS, [turn])
        if turn >= pitman_yor.BURN_IN:
            kept.append(tables)
    return np.concatenate(kept)


@pytest.mark.parametrize("customers", [16, 64, 256])
def test_production_rounds_reach_the_seating_law(customers):
    for t, p in seating_law(5, 0.4, 0.7).items():
        assert abs(summed_seating_law(5, 0.4, 0.7)[t] - p) < 1e-9
    law = summed_seating_law(customers, 0.4, 0.7)
    got = np.bincount(production_tables(customers, 0.4, 0.7), minlength=customers + 1) / 12_000
    assert abs(got - law).max() < 0.02, (got[:12], law[:12])


def test_large_and_small_pairs_follow_one_law():
    for discount in (0.05, 0.5, 0.7, 0.95):
        n, c = np.arange(1, 301), pitman_yor.LISTED
        got = pitman_yor.log_weights(np.full(300, c), n, np.full(300, 1.0), discount) + math.lgamma(c + 1)
        assert abs(got - pitman_yor.listed_ways(discount)[c, 1:301] - n * math.log(discount)).max() < 1e-6
    for rate in (0.01, 0.4):
        means = [production_tables(c, rate, 0.7, 1000).mean() for c in (256, 257, pitman_yor.LISTED, pitman_yor.LISTED + 1)]
        assert max(means) < 1.1 * min(means), means
    law = summed_seating_law(1500, 0.4, 0.7)
    got = np.bincount(production_tables(1500, 0.4, 0.7, 1000), minlength=1501) / 4_000
    assert abs(got - law).max() < 0.04
    # Many tables: the window has to lie around them.
    for c in (1024, 1025, 5000):
        for rate in (3.0, 700.0):
            tables = pitman_yor.drawn_tables(np.full(400, c), np.full(400, 0.7 * rate), 0.7, np.random.default_rng(c))
            n = np.arange(1, c + 1)
            logs = pitman_yor.log_weights(np.full(c, c), n, np.full(c, rate), 0.7)
            chances = np.exp(logs - logs.max())
            mean = (chances * n).sum() / chances.sum()
            deviation = math.sqrt((chances * (n - mean) ** 2).sum() / chances.sum())
            assert abs(tables.mean() - mean) < 5 * deviation / 20


def test_tables_of_the_parent_follow_the_law():
    customers = np.full(2001, 40.0)
    customers[-1] = 0
    rng, own, means = np.random.default_rng(1), None, []
    for _ in range(40):
        root = pitman_yor.root_of(np.ones(2001), customers, 0.7, rng, own)
        own = root.own
        means.append(own[:-1].mean())
    # Each of so many dishes has the same share: the mean settles where it gives itself.
    d, mean = pitman_yor.ROOT_DISCOUNT, 1.0
    for _ in range(200):
        weights = np.exp(np.arange(1, 41) * math.log(d * (pitman_yor.ROOT_STRENGTH / d / 2000 + mean)) + pitman_yor.listed_ways(d)[40, 1:41])
        mean = (weights * np.arange(1, 41)).sum() / weights.sum()
    assert abs(np.mean(means[20:]) - mean) < 0.05 * mean and mean > 1.5


def test_packing_of_numbers():
    values = np.unique(np.random.default_rng(1).integers(1 << 63, size=500).astype(np.uint64))
    assert (unpacked(packed(values)) == values).all() and len(unpacked(packed(values[:0]))) == 0
    assert unpacked_counts(packed_counts(np.array([1, 70_000, 3]))).tolist() == [1, 70_000, 3]


def vectors():
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=24).tolist()) for k in range(1200)]
    rows += [(2000 + k, rows[50][1]) for k in range(300)] + [(3000 + k, [2 * x for x in rows[100][1]]) for k in range(3)]
    rows += [(4000, None), (4050, [0.0] * 24), (4100, [float("nan")] + [1.0] * 23), (4150, [None] + [1.0] * 23), (4200, [float("inf")] * 24), (4250, [])]
    return rows + [rows[0], rows[50], (None, rows[3][1]), (5000, [1e200] * 24), (5050, [1.0, 2.0])]


def test_neighbours(spark):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, point string, rank int").repartition(3)
    got = hilbert_ann.nearest_neighbours(frame).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    units = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    right = total = 0
    for q in (i for i in good if i % 50 == 0):
        near = sorted((-round(float(units[q] @ units[i]), 12), i) for i in good if i != q and len(good[i]) == len(good[q]))[:5]
        mine = found.pop(q, [])
        assert len(mine) == len(near)
        assert all(abs(s - units[q] @ units[i]) < 1e-12 for i, s in mine)
        right += len({i for i, _ in mine} & {i for _, i in near})
        total += len(near)
    assert not found and right / total >= 0.95
    copies = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50]
    assert copies == [2000, 2001, 2002, 2003, 2004]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 2050] == [50, 2000, 2001, 2002, 2003]


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hilbert_ann.nearest_neighbours(frame).count() == 0


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = hilbert_ann.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
