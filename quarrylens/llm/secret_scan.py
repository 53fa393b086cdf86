"""Secrets in texts: fixed shapes, and character Markov models for the rest.

Two first-order models of characters are trained, one of random strings and
one of ordinary identifiers.  The labelled samples come from the corpus: the
values of all matches of the fixed shapes are random strings, all other
identifier-like runs are ordinary; each distinct string counts once.  What a
run of at least ``SHORTEST`` characters has left outside the fixed shapes is
searched for its best-scoring stretches, so a secret is found between words
that are joined to it.  A stretch is reported when its log-likelihood ratio
exceeds ``MARGIN``, and ``PAIR_MARGIN`` for each of its character pairs.

Everything is made of DataFrame functions.  Positions of regex matches come
from the lengths of the matches and of the parts between them.  A text is one
row from scan to span list; training shuffles the distinct samples and then
counts of character pairs, at most ``len(CODES) ** 2`` rows for each model.

A null or empty text has no spans.  Positions count code points, the end is
exclusive.  Spans of different kinds may overlap; Markov spans overlap no
other.  Rows are scanned one by one, so repeated
rows have equal spans; without any labelled samples the models agree and add
nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import pinned

# The shapes, in the order in which equal starts are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6
KINDS = ("assign", "access", "hex", "markov")
# Runs that are searched; those from ``SAMPLED`` on are labelled samples.
# They start where no such character stands before, so that a search does not
# try every character of a short word.
SHORTEST = 16
SAMPLED = 12
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
# Signs that join words; a pair with one of them never speaks for randomness.
JOINTS = "+/_=-"
# Natural-log odds beyond which a stretch is taken for random: in all, and for
# each of its character pairs.
MARGIN, PAIR_MARGIN = 12.0, 0.75
# A stretch grows while its pairs bring more than ``DRIFT`` each; it ends at
# its best point once the score has fallen by ``FALL`` from there.  It has at
# least ``STRETCH`` characters: both ends of a short secret may look ordinary.
DRIFT, FALL, STRETCH = 0.5, 12.0, 12
# Printable ASCII, as numbers from 0.
CODES = range(32, 127)
# Random strings may use all of their alphabet, whatever the samples used: this
# share of the random model is an even draw from it.
EVEN_SHARE = 0.8
# Counts that single characters have from the start.  Pairs fall back on single
# characters with the weight of so many counts.
PRIOR = 0.5
RANDOM_BACKOFF, PLAIN_BACKOFF = 20.0, 2.0
# Taken off the counts of pairs in ordinary runs: some of these are secrets of
# no fixed shape, whose odd pairs must not pass for usual ones.
PLAIN_DISCOUNT = 2.0
ALPHABET = re.compile(r"[A-Za-z0-9+/_=.-]")
# Spans folded one after the other; longer lists are folded in such pieces.
FOLDED = 128


def running_sums(items: Column, size: Column, of: Callable[[Column], Column]) -> Column:
    """Running sums of ``of(item)``, in pieces, so that no long array grows item by item."""
    pieces = F.sequence(F.lit(0), F.floor((size - 1) / FOLDED).cast("int"))

    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

        def step(state: Column, item: Column) -> Column:
            at = state["at"] + of(item)
            return F.struct(at.alias("at"), F.concat(state["ends"], F.array(at)).alias("ends"))

        return F.aggregate(part, start, step)["ends"]

    local = F.transform(pieces, lambda k: fold(F.slice(items, k * FOLDED + 1, F.lit(FOLDED))))
    shifts_start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))

    def shift(state: Column, part: Column) -> Column:
        moved = F.transform(part, lambda x: x + state["at"])
        return F.struct((state["at"] + F.element_at(part, -1)).alias("at"), F.concat(state["parts"], F.array(moved)).alias("parts"))

    return F.flatten(F.aggregate(local, shifts_start, shift)["parts"])


SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def match_spans(
    df: DataFrame, pattern: str, kind: int, column: str, value_group: int = 0, least: int = 0, sign: Column | None = None, of: str = "body"
) -> DataFrame:
    """Adds the spans of all matches of a pattern in the text ``of``, leftmost and not overlapping.

    ``sign`` is a cheap condition that holds wherever the pattern matches.
    """
    matched = F.col(of).rlike(pattern)
    hit = F.col("_hit")
    found = df.withColumn("_hit", matched if sign is None else F.when(sign, matched).otherwise(False)).select(
        "*",
        F.when(hit, F.regexp_extract_all(of, F.lit(pattern), F.lit(0))).alias("_found"),
        F.when(hit, F.regexp_extract_all(of, F.lit(pattern), F.lit(value_group))).alias("_value"),
        F.when(hit, F.split(of, pattern, -1)).alias("_gaps"),
    )
    pairs = F.transform("_found", lambda m, k: F.struct((F.length(F.col("_gaps")[k]) + F.length(m)).alias("n"), F.length(m).alias("m")))
    found = found.withColumn("_pairs", pairs)
    found = found.withColumn("_ends", F.when(hit, running_sums(F.col("_pairs"), F.size("_pairs"), lambda p: p["n"])))
    spans = F.transform(
        "_ends",
        lambda e, k: F.struct(
            (e - F.col("_pairs")[k]["m"]).alias("start"),
            e.alias("end"),
            F.lit(kind).alias("kind"),
            F.col("_value")[k].alias("value"),
        ),
    )
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    spans = F.when(hit, spans).otherwise(F.array().cast(SPAN))
    return found.withColumn(column, spans).drop("_hit", "_found", "_value", "_gaps", "_pairs", "_ends")


def names_secret() -> Column:
    """Whether a word that an assignment starts with occurs; plain substring searches."""
    low = F.lower("body")
    return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, body and the spans of the fixed shapes, one column each."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"))
    rows = match_spans(rows, ASSIGN, 0, "assign", value_group=1, least=ASSIGNED, sign=names_secret())
    rows = match_spans(rows, ACCESS, 1, "access", sign=F.col("body").contains("AKIA"))
    return match_spans(rows, HEX, 2, "hex")


def blanked(known: Column) -> Column:
    """``body`` with blanks in the place of known spans, so that all positions stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        plain = F.substring(F.col("body"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        gap = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], state["at"]), F.lit(0)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(plain, gap)).alias("parts"))

    def whole(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(F.col("body"), state["at"] + 1, F.length("body")))

    return F.when(F.size(known) > 0, F.aggregate(F.sort_array(known), start, step, whole)).otherwise(F.col("body"))


def without_known(docs: DataFrame) -> DataFrame:
    """The spans of the fixed shapes, and ``rest``: the text without them."""
    rows = base_spans(docs).withColumn("known", F.concat("assign", "access", "hex"))
    return rows.withColumn("rest", blanked(F.col("known")))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(value, random) for every distinct match of a fixed shape and other identifier-like run."""
    secret = F.transform("known", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("random")))
    runs = F.regexp_extract_all("rest", F.lit(RUN % SAMPLED), F.lit(0))
    plain = F.transform(runs, lambda v: F.struct(v.alias("value"), F.lit(False).alias("random")))
    samples = without_known(docs).select(F.concat(secret, plain).alias("samples"))
    return samples.select(F.explode_outer("samples").alias("s")).filter("s is not null").select("s.*").distinct()


def characters(text: Column) -> Column:
    """The characters of a text; reading them by position would start anew for each."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def pair_ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, indexed by first * len(CODES) + second.

    Counts are added up over all samples before they reach the driver; they
    are bounded by the alphabet.
    """
    n = len(CODES)
    spelt = samples.select("random", characters(F.col("value")).alias("letters"))
    pairs = F.transform("letters", lambda c, i: F.concat(c, F.get("letters", i + 1)))
    counts = spelt.select("random", F.explode_outer(pairs).alias("pair")).filter("pair is not null").groupBy("random", "pair").agg(F.count("*").alias("n"))
    pairs_seen: dict[bool, list[float]] = {kind: [0.0] * (n * n) for kind in (True, False)}
    for row in counts.collect():
        if len(row.pair) == 2 and all(ord(c) in CODES for c in row.pair):
            pairs_seen[row.random][(ord(row.pair[0]) - CODES[0]) * n + ord(row.pair[1]) - CODES[0]] += row.n
    if not any(map(any, pairs_seen.values())):
        return [0.0] * (n * n)
    even = [1.0 if ALPHABET.match(chr(c)) else PRIOR / n for c in CODES]
    random = _chances(pairs_seen[True], [PRIOR] * n, RANDOM_BACKOFF)
    random = [(1 - EVEN_SHARE) * x + EVEN_SHARE * even[k % n] / sum(even) for k, x in enumerate(random)]
    plain = _chances([max(0.0, x - PLAIN_DISCOUNT) for x in pairs_seen[False]], [PRIOR] * n, PLAIN_BACKOFF)
    ratios = [math.log(x) - math.log(y) for x, y in zip(random, plain)]
    joint = [chr(c) in JOINTS for c in CODES]
    return [min(x, 0.0) if joint[k // n] or joint[k % n] else x for k, x in enumerate(ratios)]


def _chances(counts: list[float], prior: list[float], weight: float) -> list[float]:
    """Chances of a character after another, falling back on those of single characters."""
    n = len(prior)
    single = [prior[b] + sum(counts[b::n]) for b in range(n)]
    total = sum(single)
    after = [sum(counts[a * n : (a + 1) * n]) + weight for a in range(n)]
    return [(counts[a * n + b] + weight * single[b] / total) / after[a] for a in range(n) for b in range(n)]


def random_stretches(run: Column, lookup: Column, margin: float) -> Column:
    """(start, end) of what looks random in a run, in characters from its start.

    One fold over the characters: a running score that starts again where it
    falls to zero or by ``FALL`` below its best, and the best end so far.  A
    stretch takes in the rest of the parts between joints in which it starts
    and ends, as chance may make the ends of a secret look ordinary; stretches
    that meet in a part become one.  An end of -1 is still to come.
    """
    n = len(CODES)
    fields = "at int, code int, piece int, score double, start int, left int, best double, end int, right int"
    kind = f"struct<{fields.replace(' int', ':int').replace(' double', ':double')},held:struct<start:int,end:int>,found:array<struct<start:int,end:int>>>"
    numbers = [F.lit(-1 if name in ("code", "right") else 0) for name in [f.split()[0] for f in fields.split(", ")]]
    start = F.struct(*numbers, F.lit(None), F.array()).cast(kind)

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.alias("start"), last.alias("end"))

    def good(state: Column) -> Column:
        pairs = state["end"] - state["start"]
        odds = state["best"] + DRIFT * pairs
        return (pairs >= STRETCH - 1) & (odds > margin) & (odds > PAIR_MARGIN * pairs)

    def meets(state: Column) -> Column:
        held = state["held"]
        return held.isNotNull() & ((held["end"] < 0) | (state["left"] < held["end"]))

    def held_after(state: Column) -> Column:
        first = F.when(meets(state), state["held"]["start"]).otherwise(state["left"])
        return F.when(good(state), span(first, state["right"])).otherwise(state["held"])

    def found_after(state: Column) -> Column:
        done = good(state) & state["held"].isNotNull() & ~meets(state)
        return F.when(done, F.concat(state["found"], F.array(state["held"]))).otherwise(state["found"])

    def ended(held: Column, at: Column) -> Column:
        return F.when(held["end"] < 0, span(held["start"], at)).otherwise(held)

    def step(state: Column, letter: Column) -> Column:
        code, at, fresh = F.ascii(letter) - CODES[0], state["at"], state["score"] <= 0
        joint = letter.isin(*JOINTS)
        gain = F.when(state["code"] < 0, 0.0).otherwise(F.get(lookup, state["code"] * n + code) - DRIFT)
        score = F.when(fresh, 0.0).otherwise(state["score"]) + gain
        best = F.when(fresh, 0.0).otherwise(state["best"])
        first = F.greatest(at - 1, F.lit(0))
        right = F.when(fresh | (score > best), -1).otherwise(state["right"])
        held = F.when(fresh, held_after(state)).otherwise(state["held"])
        return F.struct(
            at + 1, code, F.when(joint, at + 1).otherwise(state["piece"]), F.when(score < best - FALL, 0.0).otherwise(score),
            F.when(fresh, first).otherwise(state["start"]), F.when(fresh, state["piece"]).otherwise(state["left"]),
            F.greatest(score, best), F.when(score > best, at).when(fresh, first).otherwise(state["end"]),
            F.when(joint & (right < 0), at).otherwise(right), F.when(joint, ended(held, at)).otherwise(held),
            F.when(fresh, found_after(state)).otherwise(state["found"]),
        ).cast(kind)

    def finish(state: Column) -> Column:
        last = held_after(state)
        return F.concat(found_after(state), F.when(last.isNotNull(), F.array(ended(last, state["at"]))).otherwise(F.array()))

    return F.aggregate(characters(run), start, step, finish)


def secret_spans(docs: DataFrame, ratios: list[float] | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, body, the spans of each kind and ``all_spans`` by start, then kind."""
    table = pair_ratios(labelled_samples(docs)) if ratios is None else ratios
    lookup = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")
    rows = match_spans(without_known(docs), RUN % SHORTEST, 3, "runs", of="rest")

    def moved(run: Column) -> Column:
        place = lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), run["kind"].alias("kind"))
        return F.transform(random_stretches(run["value"], lookup, margin), place)

    rows = rows.withColumn("markov", F.flatten(F.transform("runs", moved))).drop("runs", "known", "rest")
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    every = F.concat(*[F.transform(k, order) for k in KINDS])
    return rows.withColumn("all_spans", F.sort_array(every))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, numbers of base spans, their digest, and all spans spelled out."""
    rows = secret_spans(docs, margin=margin)
    base = F.filter("all_spans", lambda s: s["kind"] < 3)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, pinned(F.sha2(spelled(base), 256)).alias("base_sha256"), spelled(F.col("all_spans")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "<secret>", ratios: list[float] | None = None) -> DataFrame:
    """The documents with every span, of any kind, replaced; n_chars follows where present.

    Overlapping spans are masked as one.
    """
    table = pair_ratios(labelled_samples(docs)) if ratios is None else ratios
    rows = secret_spans(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), table)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        plain = F.substring(F.col("body"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = F.concat(state["parts"], F.array(plain, F.lit(mask)))
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["parts"]).otherwise(fresh).alias("parts"))

    folded = F.aggregate("all_spans", start, step)
    rest = F.substring(F.col("body"), F.col("folded.at") + 1, F.length("body"))
    masked = F.concat(F.array_join("folded.parts", ""), rest)
    rows = rows.withColumn("folded", F.when(F.size("all_spans") > 0, folded))
    text = F.when(F.size("all_spans") > 0, masked).otherwise(F.col("doc_id.text"))
    rows = rows.withColumn("masked", text)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(pinned(F.col("masked")).alias("text"))
        elif c == "n_chars":
            changed = F.length("masked").cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(F.size("all_spans") > 0, changed).otherwise(F.col("doc_id.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"doc_id.`{c}`").alias(c))
    return rows.select(*columns)
