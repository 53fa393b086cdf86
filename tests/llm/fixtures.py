"""Small tables with the awkward rows that every operator must take."""

import random

WORDS = "the of and river stone amber quiet lantern meadow copper walk under seven night garden window sailor".split()
DOCS = "doc_id long, text string, lang string, kept string, words string, n_lines long, cell string"


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, white space, ties, repeated rows, and a very long text."""
    shared = "this very line is repeated in a good many of the documents here"
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three")]
    rows += [(7 + k, prose(k) + f"\n  {shared.upper() if k % 2 else shared}\t\n" + prose(100 + k, 30)) for k in range(7)]
    rows += [(20, prose(3)), (21, prose(3)), (22, prose(3) + " and more")]
    rows += [(20, prose(3)), (23, prose(9) + "\n" + shared), (23, prose(9) + "\n" + shared), (None, prose(9)), (None, None)]
    rows += [(30, "\n".join(prose(k, 40) for k in range(400))), (31, "a" * 5000), (32, "é" * 300 + "\x00  　 x")]
    return rows


def awkward(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None, "clash", "clash", 9, "clash") for i, t in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
