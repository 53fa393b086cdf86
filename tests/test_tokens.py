"""Words of Arrow arrays equal those of the column function."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import tokens
from quarrylens.functions.text import STRIPPED_PUNCTUATION, WHITESPACE, tokenize
from quarrylens.functions.tokens import words_of


@pytest.mark.parametrize("size", [4 << 20, 50, 1])
def test_words_equal_the_column_function(spark, monkeypatch, size):
    monkeypatch.setattr(tokens, "SLICE_BYTES", size)
    rng = random.Random(4)
    # All white space and punctuation; characters that share their first byte with white space; an end sign, wide characters.
    signs = list(WHITESPACE + STRIPPED_PUNCTUATION + "abcXYZ%09éß§²İΣ漢字、がᚁ–€‼😀​﻿\x00\x7f")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["", None, "  ", "..", " a", "b ", "c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    table = rows.select(F.lower("t").alias("lower"), tokenize(F.col("t")).alias("words")).toArrow()
    want = [found or [] for found in table.column("words").to_pylist()]
    words, counts = words_of(table.column("lower"))
    assert counts.tolist() == [len(found) for found in want]
    assert words.to_pylist() == [word for found in want for word in found]
    some, held = words_of(table.column("lower").combine_chunks().slice(7, 100))
    assert held.tolist() == counts[7:107].tolist() and some.to_pylist() == [word for found in want[7:107] for word in found]


def test_no_words():
    assert [len(part) for part in words_of(pa.array([], pa.string()))] == [0, 0]
    words, counts = words_of(pa.array(["", None, " . "], pa.string()))
    assert len(words) == 0 and counts.tolist() == [0, 0, 0]
