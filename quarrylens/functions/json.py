"""Strict JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing more; else null.

    ``try_parse_json`` stops after the first value and accepts what follows.
    Placed in an array and in an object the text must fill both, which no
    text with a second value or a stray bracket can.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(keyed, "$.v", "variant"))
