"""Quality rules: a threshold table compiled into one Spark projection.

Words are runs without ASCII white space, lines are cut at newlines.  All
measures are column expressions over arrays of the row; nothing is shuffled
and no user function runs.  ``RULES`` is the threshold table: each row names a
ratio of two measures and the bounds within which a document is kept.

A null text counts as empty: no words, so the base rule rejects it.  A rule
whose denominator is 0 holds.  Rows are judged one by one, so repeated rows
get equal verdicts, and an empty table an empty result.  Columns named like a
measure are replaced in the verdict table, which carries the id alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import pinned

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

# Very frequent function words of the languages served.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from an or not you have he they but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht eine ein als auch es an".split(),
    "fr": "de la le et les des en un du une que pour est dans qui par au sur pas avec il ne ce".split(),
    "es": "de la que el en y los se las del un por con no una su para al es lo como más".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``lowest`` * below <= above <= ``highest`` * below."""

    name: str
    above: str
    below: str
    lowest: float | None
    highest: float | None


RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols to words", "n_symbols", "n_words", None, 0.2),
    Rule("stop words to words", "n_stop_words", "n_words", 0.03, None),
    Rule("repeated lines to lines", "n_dup_lines", "n_word_lines", None, 0.5),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules speak of."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    text = F.coalesce(F.col("text"), F.lit(""))
    # Each step names arrays that the next one uses several times, so that
    # Spark computes them once instead of folding them into the formulas.
    parts = docs.select(
        "doc_id",
        text.alias("body"),
        F.array_remove(F.split(text, SPACE, -1), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    n = F.size("words")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]),
    )
    counted = parts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_word_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # Windows with their places are sorted only where some window comes twice.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_rows = counted.withColumn("placed", F.when(twice, placed)).drop("windows")
    count = F.size("placed")

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(F.get("placed", a)["h"] == F.get("placed", b)["h"], F.lit(False))

    found = F.filter(F.sequence(F.lit(0), count - 1), lambda k: equal(k, k - 1) | equal(k, k + 1))
    starts = F.sort_array(F.transform(found, lambda k: F.get("placed", k)["i"]))
    spotted = sorted_rows.withColumn("starts", F.when(F.col("placed").isNotNull(), starts)).drop("placed")
    # A window covers three words unless the next repeated one begins sooner.
    reach = F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return spotted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("starts")


def holds(rule: Rule) -> Column:
    """The rule as an expression over the measures."""
    above, below = F.col(rule.above), F.col(rule.below)
    verdict = below == 0
    within = F.lit(True)
    if rule.lowest is not None:
        within = within & (above >= rule.lowest * below)
    if rule.highest is not None:
        within = within & (above <= rule.highest * below)
    return verdict | within


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, the names of broken rules, and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = [F.when(~holds(rule), F.lit(rule.name)) for rule in rules]
    broken_rules = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    judged = measures(docs).withColumn("base_failed", base).withColumn("broken_rules", broken_rules)
    return judged.withColumn("kept", pinned(~F.col("base_failed") & (F.size("broken_rules") == 0)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with all their columns; judged in the row, never joined by id."""
    whole = F.struct(*docs.columns)
    judged = quality_verdicts(docs.select(whole.alias("doc_id"), F.col("text")), rules)
    return judged.filter("kept").select("doc_id.*")
