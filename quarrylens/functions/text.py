"""Column functions for text.  Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
# ASCII punctuation removed before splitting; the percent sign is kept.
STRIPPED_PUNCTUATION = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Unicode white space as a string splitter sees it, file separators included.
WHITESPACE_CLASS = r"(?U)[\s\x1c-\x1f]"
# The same characters one by one, for trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The DNS name space of version-5 identifiers.
NAMESPACE_DNS_HEX = "6ba7b8109dad11d180b400c04fd430c8"
# --------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim every kind of white space on both ends, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def tokenize(text: Column) -> Column:
    """Lower case, delete punctuation, split on white space, drop empties."""
    cleaned = F.translate(F.lower(text), STRIPPED_PUNCTUATION, "")
    return F.array_remove(F.split(cleaned, WHITESPACE_CLASS + "+"), "")


def token_count(text: Column) -> Column:
    """Token estimate: a quarter of the characters, plus one."""
    return F.floor(F.length(text) / 4) + 1


def word_weight(word: Column) -> Column:
    """Token estimate of a word together with the blank that follows it."""
    return F.floor((F.length(word) + 1) / 4) + 1


def normalize_ws(text: Column) -> Column:
    """Collapse white space, trim, fold case: the form quotes are compared in."""
    return F.lower(F.trim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " ")))


def point_id(key: Column) -> Column:
    """Deterministic version-5 identifier of a chunk id."""
    named = F.concat(F.unhex(F.lit(NAMESPACE_DNS_HEX)), F.encode(key, "UTF-8"))
    digest = F.sha1(named)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def digest_number(text: Column, hex_digits: int = 13) -> Column:
    """Leading bits of a digest as a number; 13 digits are exact in a double."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, hex_digits), 16, 10).cast("long")


def overlap_share(left: Column, right: Column) -> Column:
    """Share of the distinct items of ``left`` found in ``right``; null when empty."""
    distinct = F.array_distinct(left)
    hits = F.size(F.array_intersect(distinct, right)).cast("double")
    return F.when(F.size(distinct) > 0, hits / F.size(distinct))
