"""Periodic runs, SimHash and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from tests.llm.fixtures import DOCS, awkward, awkward_texts, empty, prose

from quarrylens.llm import periodic_runs, simhash_dedup, whitening
from quarrylens.llm.queries import with_planted_runs
from quarrylens.llm.simhash_dedup import band_masks, close_pairs, fingerprint, least_members

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- periodic runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        same = [w[k] == w[k + q] for k in range(len(w) - q)] + [False]
        k = 0
        while k < len(same):
            e = k
            while same[e]:
                e += 1
            a, b = k, e + q
            if e > k and b - a >= max(24, 3 * q) and not any(all(w[x] == w[x + d] for x in range(a, b - d)) for d in range(1, q)):
                out.append((a, b - a, q))
            k = e + 1
    return sorted(out)


def brute_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        letters = rng.choice([1, 2, 3, 5, 50])
        w = [str(rng.randrange(letters)) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            base = [str(rng.randrange(letters)) for _ in range(rng.randrange(1, 40))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [base[i % len(base)] for i in range(rng.randrange(24, 160))]
        if k % 6 == 1:
            w = (["a"] * rng.randrange(1, 60) + ["b"]) * rng.randrange(1, 10)
        if k % 6 == 2:
            w = (["a", "b"] * rng.randrange(1, 20) + ["c"]) * rng.randrange(1, 8)
        yield " ".join(w)


def runs_of(spark, rows):
    docs = spark.createDataFrame([(i, t, None, "clash", "clash", 9, "clash") for i, t in rows], DOCS).repartition(3)
    return periodic_runs.periodic_runs(docs)


def test_runs_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(periodic_texts(3, 120))]
    rows += [(1000 + i if i is not None else None, t) for i, t in awkward_texts()]
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in runs_of(spark, rows).collect())
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = brute_runs(w) if len(w) < 2000 else []
        want.append((str(i), runs, brute_collapsed(w, runs)))
    assert got == sorted(want)


def test_tile_edges_do_not_matter(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(periodic_texts(4, 60))]
    monkeypatch.setattr(periodic_runs, "BOUNDARIES", 1)
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs_of(spark, rows).collect()}
    assert got == {i: brute_runs(t.split()) for i, t in rows}


def test_long_texts_have_their_runs(spark):
    block = [f"w{k}" for k in range(700)]
    rows = [(1, "a " * 30000), (2, " ".join(block * 9 + ["end"])), (3, " ".join(block))]
    got = {r.doc_id: ([tuple(x) for x in r.runs], len(r.collapsed.split())) for r in runs_of(spark, rows).collect()}
    assert got == {1: ([(0, 30000, 1)], 1), 2: ([(0, 6300, 700)], 701), 3: ([], 700)}


def test_progressions_keep_all_pairs():
    rng = np.random.default_rng(5)
    pairs = np.unique(np.stack([rng.integers(0, 9, 200), rng.integers(1, 60, 200)], axis=1), axis=0)
    at, first, stride, times = periodic_runs.progressions(pairs[:, 0], pairs[:, 1])
    assert [(c, p + s * k) for c, p, s, n in zip(at, first, stride, times) for k in range(n)] == [tuple(x) for x in pairs.tolist()]


def test_planted_passages_and_digests(spark):
    rows = [(k, prose(k, 90)) for k in range(300)] + [(300 + k, t) for k, t in enumerate(["", None, "one two", " \n"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    planted = with_planted_runs(docs)
    got = {r.doc_id: r for r in periodic_runs.run_digests(periodic_runs.periodic_runs(planted)).collect()}
    seen = 0
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = brute_runs(w)
        seen += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert seen >= 10 and len(got) == len(rows)


def test_no_documents_no_runs(spark):
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(empty(spark))).collect() == []


# --- SimHash


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWERED))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    forms = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (forms[a] ^ forms[b]).bit_count() <= 2:
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)] += [i] if i is not None else []
    return sorted((str(i), f"{forms[k]:016x}", str(min(ids[root(k)], default=None))) for k, (i, _) in enumerate(rows))


def simhash_rows():
    rng = random.Random(12)
    rows = awkward_texts()
    for group in range(5):
        words = prose(2000 + group, 400).split()
        for copy in range(12):
            changed = list(words)
            for _ in range(copy % 4):
                changed[rng.randrange(len(changed))] = "changed"
            rows.append((500 + 20 * group + copy, " ".join(changed)))
    return rows


def test_fingerprints_equal_the_definition():
    for _, t in awkward_texts():
        assert fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("bucket, free_bits", [(4096, 14), (2, 14), (1, 30)])
def test_components_equal_brute_force(spark, bucket, free_bits):
    rows = simhash_rows()
    found = simhash_dedup.near_duplicates(awkward(spark, rows), bucket=bucket, free_bits=free_bits)
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found.collect())
    want = brute_components(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_planes_count_all_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 8, replace=False)) for k in range(400)], dtype=np.uint64)
    forms = base[rng.integers(0, 40, 400)] ^ flips
    ends = np.where(np.arange(400) < 130, 130, 400)
    left, right, planes = close_pairs(forms, ends, radius)
    want = {(a, b) for a in range(400) for b in range(a + 1, ends[a]) if (int(forms[a]) ^ int(forms[b])).bit_count() <= radius}
    assert set(zip(left.tolist(), right.tolist())) == want and len(left) == len(want)


def test_far_blocks_are_abandoned():
    forms = np.random.default_rng(1).integers(0, 1 << 63, 2048, dtype=np.uint64)
    _, _, planes = close_pairs(forms, np.full(2048, 2048))
    blocks = sum((2047 // 64) - (k + 1) // 64 + 1 for k in range(2047))
    assert planes < 0.5 * 64 * blocks


def test_bands_leave_no_close_pair_apart():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        above = {0}
        for depth in band_masks():
            above = {q for p, q, m in depth if p in above and a & m == b & m}
            assert above
    assert max(64 - m.bit_count() for _, _, m in band_masks()[-1]) <= simhash_dedup.FREE_BITS


def test_least_members():
    least = least_members(6, np.array([4, 2, 5]), np.array([5, 3, 1]))
    assert least.tolist() == [0, 1, 2, 2, 1, 1]


def test_no_documents_no_fingerprints(spark):
    assert simhash_dedup.near_duplicates(empty(spark)).collect() == []


# --- whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, n string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "clash", "clash") for i, v in rows], VECTORS).repartition(3)


def whitened(spark, rows, **options):
    return whitening.whiten(vectors_frame(spark, rows), **options).collect()


@pytest.mark.parametrize("width, count", [(5, 32), (40, 32), (6, 2)])
def test_whitening_equals_the_definition(spark, width, count):
    rng = np.random.default_rng(width)
    data = (rng.normal(size=(300, width)) @ rng.normal(size=(width, width)) + 3).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(7, data[0].tolist()), (None, data[1].tolist())]
    bad = [(900, None), (901, [float("nan")] * width), (902, [float("inf")] + [1.0] * (width - 1)), (903, [None] + [1.0] * (width - 1)), (904, []), (905, [1.0])]
    got = whitened(spark, rows + bad, components=count)
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 1000000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == n * min(count, width)
    z = defaultdict(list)
    for r in got:
        z[r.component].append((r.deviation, r.vec_id if r.vec_id is not None else -1, r.whitened))
        assert r.n == n and abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9
        assert r.identity_error < 1e-9
    for k in range(min(count, width)):
        want = centred @ axes[:, k] / math.sqrt(values[k])
        expected = sorted((int(d), i if i is not None else -1, w) for d, (i, _), w in zip(deviation, rows, want))
        mine = sorted(z[k + 1])
        assert [(d, i) for d, i, _ in mine] == [(d, i) for d, i, _ in expected]
        sign = np.sign(np.dot([w for *_, w in mine], [w for *_, w in expected]))
        np.testing.assert_allclose([sign * w for *_, w in mine], [w for *_, w in expected], atol=1e-7)


def test_the_same_for_any_partitioning(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(100, 8)).astype(np.float32))]
    frame = vectors_frame(spark, rows)
    first, second = (sorted(map(tuple, whitening.whiten(frame.repartition(p)).collect())) for p in (1, 7))
    # The model is the same to the last bit; products of single rows are rounded by batches.
    assert [(r[:4], r[5]) for r in first] == [(r[:4], r[5]) for r in second]
    np.testing.assert_allclose([r[4] for r in first], [r[4] for r in second], rtol=1e-9, atol=1e-12)


def test_vectors_without_variance(spark):
    assert whitening.whiten(vectors_frame(spark, [])).collect() == []
    assert whitening.whiten(vectors_frame(spark, [(1, None)])).collect() == []
    one = whitened(spark, [(4, [1.0, 2.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (4, 1, 1, 0, None, None, None), (4, 2, 1, 0, None, None, None)
    ]
    flat = whitened(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(6)])
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert all(r.identity_error < 1e-9 for r in flat)
    huge = whitened(spark, [(k, [1e30 * k, 1.0]) for k in range(4)])
    assert len(huge) == 8 and huge[0].deviation is None


def spectrum(kind, d):
    rng = np.random.default_rng(d)
    if kind == "repeated":
        return np.diag(np.repeat(np.arange(1.0, d // 2 + 2), 2)[:d])
    if kind == "identity":
        return 3 * np.eye(d)
    a = rng.normal(size=(3 if kind == "few" else 4 * d, d))
    if kind == "graded":
        a = a * np.logspace(0, -5, d)
    return a.T @ a / len(a)


@pytest.mark.parametrize("kind", ["plain", "few", "graded", "repeated", "identity"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_components_are_orthonormal_and_exact(kind, d):
    matrix = spectrum(kind, d)
    values, axes = whitening.components_of(matrix)
    scale = np.abs(matrix).max()
    np.testing.assert_allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-13 * scale * d)
    np.testing.assert_allclose(axes.T @ axes, np.eye(d), atol=1e-13)
    np.testing.assert_allclose(matrix @ axes, axes * values, atol=1e-13 * scale * d)


def test_polar_factor_is_the_sign_of_the_spectrum():
    values, axes = np.linalg.eigh(spectrum("plain", 20) - 1.0 * np.eye(20))
    want = (axes * np.sign(values)) @ axes.T
    np.testing.assert_allclose(whitening.polar((axes * values) @ axes.T), want, atol=1e-12)


# --- joins of hot keys


@pytest.mark.parametrize("heavy_keys", [1, 3, 1024])
@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_hot_keys_join_like_others(spark, monkeypatch, heavy_keys, how):
    from quarrylens.llm import shared

    monkeypatch.setattr(shared, "HEAVY_KEYS", heavy_keys)
    rows = [(k % 7 if k % 3 else 0, k) for k in range(90)]
    side = [(0, 40, "hot"), (1, 9, "a"), (4, 8, "b"), (9, 0, "absent")]
    left = spark.createDataFrame(rows, "key int, v int")
    right = spark.createDataFrame(side, "key int, n int, name string")
    got = sorted(map(tuple, shared.join_weighted(left, right, ["key"], "n", how).collect()))
    assert got == sorted(map(tuple, left.join(right, ["key"], how).collect())) and got


def test_components_equal_brute_force_with_light_forms(spark, monkeypatch):
    from quarrylens.llm import shared

    monkeypatch.setattr(shared, "HEAVY_KEYS", 8)
    rows = simhash_rows()
    found = simhash_dedup.near_duplicates(awkward(spark, rows), bucket=2)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found.collect()) == brute_components(rows)
