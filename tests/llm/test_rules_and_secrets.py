"""Quality rules and secret scans against plain Python."""

import hashlib
import random
import re
import string
from collections import Counter

from tests.llm.fixtures import awkward, awkward_texts, empty, prose

from quarrylens.llm import quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    symbols = sum(text.count(c) for c in quality_rules.SYMBOLS)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def junk_texts():
    return [
        (50, " ".join(["Et"] * 80)),
        (51, " ".join(w + "###" for w in prose(4).split())),
        (52, "\n".join([prose(5, 12)] * 9 + [prose(6, 60)])),
        (53, prose(7).upper().replace(" ", "!! ")),
        (54, "a b a b a b c d e " * 3 + prose(8)),
    ]


def test_measures_and_verdicts(spark):
    rows = awkward_texts() + junk_texts()
    got = quality_rules.quality_verdicts(awkward(spark, rows)).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == Counter((i, *counted(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {50, 51, 52, 53} and {7, 8, 20, 54} <= kept
    good = quality_rules.keep_good(awkward(spark, rows))
    assert good.columns == awkward(spark).columns and {r.doc_id for r in good.collect()} == kept
    assert quality_rules.quality_verdicts(empty(spark)).count() == 0


def test_rules_are_a_table(spark):
    rule = quality_rules.Rule("only long words", "word_chars", "n_words", 100.0, None)
    broken = quality_rules.quality_verdicts(awkward(spark, [(1, prose(1)), (2, None)]), (rule,)).collect()
    assert {r.doc_id: r.broken_rules for r in broken} == {1: ["only long words"], 2: []}


def secret_texts():
    rng = random.Random(6)
    draw = lambda kind, n: "".join(rng.choice(kind) for _ in range(n))
    hexes = [draw("0123456789abcdef", 40) for _ in range(60)]
    rows = [(200 + k, f"{prose(k, 20)} token = \"{h}\" {prose(k + 50, 20)} {h}") for k, h in enumerate(hexes)]
    rows += [
        (300, "password=token:abcdefgh Secret: 'abc.def-1' API_KEY='xyzxyzxyz' apikey:short passwd=1234567"),
        (301, f"é🙂 AKIA{draw(string.ascii_uppercase, 16)} AKIA123 {draw('abcdef', 24)}{draw('0123', 3)}z"),
        (302, " ".join(f"secret={draw(string.ascii_lowercase, 8)}" for _ in range(300))),
        (303, f"{prose(2, 30)} {draw(string.ascii_letters + string.digits, 44)} {prose(3, 30)}"),
        (304, prose(9) + " internationalisation straightforwardnesses counterrevolutionary"),
    ]
    parts = "inter national isation counter revolution ary straight forward ness micro electronics under standing es".split()
    rows += [(400 + k, " ".join("".join(rng.choice(parts) for _ in range(4)) for _ in range(60))) for k in range(40)]
    return rows


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_spans(spark):
    rows = awkward_texts() + secret_texts()
    got = secret_scan.secret_report(awkward(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id is None:
            continue
        spans = base(texts[r.doc_id])
        spelled = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        if not r.n_markov:
            assert r.spans == spelled
    by_id = {r.doc_id: r for r in got}
    assert by_id[303].n_markov == 1 and by_id[304].n_markov == 0 and by_id[302].n_assign == 300
    start, end = map(int, by_id[303].spans.split(":")[1:])
    assert len(texts[303][start:end]) == 44
    assert secret_scan.secret_report(empty(spark)).count() == 0


def test_masking(spark):
    rows = secret_texts() + [(1, None), (2, "")]
    masked = {r.doc_id: r for r in secret_scan.mask_secrets(awkward(spark, rows), "#").collect()}
    assert masked[1].text is None and masked[2].text == "" and masked[1].kept == "clash"
    for i, t in rows:
        spans = [(a, b) for a, _, b in base(t)]
        want, at = "", 0
        for a, b in spans:
            if a >= at:
                want += t[at:a] + "#"
            at = max(at, b)
        if i < 303 and t:
            assert masked[i].text == want + t[at:]
    assert "#" in masked[303].text and masked[304].text == dict(rows)[304]


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    random_strings = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    parts = "inter national ization counter revolution ary straight forward ness micro electronics under standing".split()
    names = ["".join(rng.choice(parts) for _ in range(4)) for _ in range(300)]
    train = spark.createDataFrame([(v, True) for v in random_strings[:200]] + [(v, False) for v in names[:200]], "value string, random boolean")
    ratios = secret_scan.pair_ratios(train)
    n = len(secret_scan.CODES)

    def ratio(v):
        return sum(ratios[(ord(a) - 32) * n + ord(b) - 32] for a, b in zip(v, v[1:]))

    right = sum(ratio(v) > secret_scan.MARGIN for v in random_strings[200:]) + sum(ratio(v) <= secret_scan.MARGIN for v in names[200:])
    assert right >= 196


WORDS = "aningble chlichkeit entheron oferndaned thingreat mentleau rebleanin vershauf tiononal ouelleant eringder theawhth unghaben nichtder".split()


def invented(rng):
    """A word of the syllables of ``WORDS``, which are what the models learn as ordinary."""
    return "".join(w[:4] if rng.random() < 0.5 else w[4:] for w in rng.sample(WORDS, rng.randint(2, 3)))


def joined_ratios(spark, rng):
    train = [("".join(rng.choice("0123456789abcdef") for _ in range(40)), True) for _ in range(200)]
    train += [("".join(invented(rng) for _ in range(2)), False) for _ in range(6000)]
    return secret_scan.pair_ratios(spark.createDataFrame(train, "value string, random boolean").distinct())


def test_secrets_inside_runs(spark):
    """Random strings joined to words are found, joined words alone are not."""
    rng = random.Random(21)
    ratios = joined_ratios(spark, rng)
    rows, places = [], {}
    for alphabet, n in ((string.ascii_letters + string.digits, 20), (string.ascii_lowercase + string.digits, 24)):
        for words in (0, 3, 5, 8):
            for _ in range(40):
                sign = rng.choice("/_-")
                before = "see " + "".join(invented(rng) + sign for _ in range(words))
                secret = "".join(rng.choice(alphabet) for _ in range(n))
                places[len(rows)] = (len(before), len(before) + n)
                rows.append((len(rows), before + secret + (sign + invented(rng) if words else "")))
    plain = range(len(rows), len(rows) + 400)
    rows += [(k, rng.choice("/_-").join(invented(rng) for _ in range(rng.randint(2, 12)))) for k in plain]
    found = {r.doc_id: r.markov for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()}
    hits = sum(any(min(b, m.end) - max(a, m.start) >= 0.8 * (b - a) for m in found[k]) for k, (a, b) in places.items())
    assert hits >= 0.95 * len(places)
    assert sum(bool(found[k]) for k in plain) <= 0.01 * len(plain)


def test_what_base_spans_leave_is_judged(spark):
    rng = random.Random(22)
    ratios = joined_ratios(spark, rng)
    secret = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    shaped = "".join(rng.choice("0123456789abcdef") for _ in range(30))
    url = f"https://{invented(rng)}.example/{invented(rng)}/{secret}/{invented(rng)}"
    rows = [(1, f"{shaped}/{secret}"), (2, url), (3, f"é🙂 token={shaped} {secret}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in secret_scan.secret_spans(docs, ratios).collect():
        (span,) = r.markov
        at = r.body.index(secret)
        assert min(span.end, at + 32) - max(span.start, at) >= 28
        assert all(span.end <= s.start or s.end <= span.start for s in [*r.assign, *r.access, *r.hex])
    masked = {r.doc_id: r.text for r in secret_scan.mask_secrets(docs, "#", ratios).collect()}
    assert secret[4:28] not in masked[2] and masked[2].startswith("https://")


def test_long_runs_are_one_fold(spark):
    rng = random.Random(23)
    text = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "a" * 200_000)], "doc_id long, text string")
    found = {r.doc_id: r.markov for r in secret_scan.secret_spans(docs, joined_ratios(spark, rng)).collect()}
    assert sum(m.end - m.start for m in found[1]) >= 190_000 and found[2] == []
