"""Edge cases of text, blocks and chunks against plain-Python brute force."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text as X
from quarrylens.operators import blocks as B
from quarrylens.operators import chunking as C


def one(spark, value, column, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(column.alias("r")).first()["r"]


def column_of(spark, values, column, ddl="i int, x string"):
    rows = spark.createDataFrame(list(enumerate(values)), ddl).select("i", column.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Pay ₹850 now", ["pay", "₹850", "now"]),
        ("18% off", ["18%", "off"]),
        ("0.5 kg", ["05", "kg"]),
        ("Section 4.2", ["section", "42"]),
        ("a b c\x1cd", ["a", "b", "c", "d"]),
        ("... !!", []),
        ("", []),
    ],
)
def test_tokenize(spark, text, expected):
    assert one(spark, text, X.tokenize(F.col("x"))) == expected


def test_point_id_is_a_version_5_uuid(spark):
    ids = ["a::0::0", "ü::1::2", ""]
    assert column_of(spark, ids, X.point_id(F.col("x"))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, i)) for i in ids]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("4.2 RETURN POLICY", True),
        ("RETURN POLICY.", False),
        ("A" * 121, False),
        ("A" * 120, True),
        ("## x", True),
        ("##### x", False),
        ("ABC", False),
        ("ABCD", True),
        ("  ABCD  ", True),
        ("Plain text", False),
        ("plain\nHEADING", False),
        ("HEADING\nplain", True),
    ],
)
def test_heading(spark, text, expected):
    assert one(spark, text, B.is_heading(F.col("x"))) is expected


def test_blocks_carry_sections(spark):
    text = "intro words\n\n# First\n\n- item\n\n2) item\n\n# Second\n\nbody"
    blocks = one(spark, text, B.text_blocks(F.col("x")))
    assert [(b.block_type, b.section_header, b.block_index) for b in blocks] == [
        ("prose", None, 0), ("heading", "# First", 1), ("list_item", "# First", 2), ("list_item", "# First", 3),
        ("heading", "# Second", 4), ("prose", "# Second", 5),
    ]
    assert one(spark, " \n\n ", B.text_blocks(F.col("x"))) == []


def test_tables(spark):
    grid = [["h|1", None], ["a\nb", " c ", "d"], []]
    markdown = one(spark, grid, B.serialize_table(F.col("x")), "x array<array<string>>")
    assert markdown == "| h\\|1 |  |  |\n| --- | --- | --- |\n| a b | c | d |\n|  |  |  |"
    # The blank row looks like a rule line and goes; the escaped pipe holds.
    assert one(spark, markdown, B.parse_markdown_table(F.col("x"))) == [["h|1", "", ""], ["a b", "c", "d"]]
    assert one(spark, [], B.serialize_table(F.col("x")), "x array<array<string>>") == ""


# Brute force ----------------------------------------------------------------


def tokens(text):
    return len(text) // 4 + 1


def pack(parts, glue, fits):
    """Chunks by trying every next part on the text itself."""
    done, held = [], None
    for part in parts:
        tried = part if not held else held + glue + part
        if fits(tried):
            held = tried
            continue
        done += [held] if held else []
        held = part
    return done + ([held] if held else [])


def pack_words(words, target):
    done, held = [], []
    for word in words:
        if held and sum(tokens(w + " ") for w in held + [word]) > target:
            done.append(held)
            held = []
        held = held + [word]
    return [" ".join(h) for h in done + [held]]


def cascade(text, target, limit):
    pieces = [text]
    for glue in C.SEPARATORS:
        pieces = [
            q
            for p in pieces
            for q in (pack(p.split(glue), glue, lambda t: tokens(t) <= target) if tokens(p) > limit and glue in p else [p])
        ]
    pieces = [q for p in pieces for q in (pack_words(p.split(" "), target) if tokens(p) > limit else [p])]
    return [p.strip() for p in pieces if p.strip()] or [text]


def random_text(rng):
    glue = ["\n\n", "\n", ". ", "! ", "? ", " ", " ", " "]
    words = ("x" * rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(0, 60)))
    return "".join(w + rng.choice(glue) for w in words)


SMALL = C.ChunkConfig(target_tokens=6, max_tokens=9, table_max_tokens=20, overlap_tokens=5)


def test_recursive_split_matches_brute_force(spark):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(300)] + ["", " ", "x" * 500, ". . . . " * 9, "\n\n\n" + "ab " * 40]
    ours = column_of(spark, texts, C.recursive_split(F.col("x"), SMALL))
    assert ours == [[t] if tokens(t) <= 9 else cascade(t, 6, 9) for t in texts]


def test_hard_split_and_merge_match_brute_force(spark):
    rng = random.Random(8)
    texts = [random_text(rng) for _ in range(200)] + ["", "y" * 300]
    assert column_of(spark, texts, C.hard_split(F.col("x"), 6)) == [pack_words(t.split(" "), 6) for t in texts]
    merged = column_of(spark, texts, C.greedy_merge(F.split("x", " "), " ", 6))
    assert merged == [pack(t.split(" "), " ", lambda c: tokens(c) <= 6) for t in texts]


def test_limits_are_inclusive(spark):
    at, over = "a b" * 1066 + "c", "a b" * 1066 + "cd"
    assert len(at) == 3199 and len(over) == 3200
    assert [len(r) for r in column_of(spark, [at, over], C.recursive_split(F.col("x")))] == [1, 2]


def render(rows):
    width = max(len(r) for r in rows)
    cells = [[c.replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def test_table_split_matches_brute_force(spark):
    rng = random.Random(9)
    tables = []
    for _ in range(150):
        rows = [["k" * rng.randint(1, 6) + rng.choice(["", "|z"]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 12))]
        tables.append(rows)
    texts = [render(t) for t in tables]

    def expected(rows, text):
        # Reading the text back gives every row the full width.
        width = max(len(r) for r in rows)
        rows = [r + [""] * (width - len(r)) for r in rows]
        if tokens(text) <= 20 or len(rows) < 2:
            return [text]
        done, held = [], []
        for row in rows[1:]:
            if held and tokens(render([rows[0], *held, row])) > 20:
                done.append(held)
                held = []
            held = held + [row]
        return [render([rows[0], *part]) for part in done + [held]]

    assert column_of(spark, texts, C.table_split(F.col("x"), 20)) == [expected(t, x) for t, x in zip(tables, texts)]
    assert one(spark, "no table " * 400, C.table_split(F.col("x"))) == ["no table " * 400]


def test_overlap_tail_matches_brute_force(spark):
    rng = random.Random(10)
    texts = [random_text(rng) for _ in range(200)] + ["", "w" * 900, "old" + C.OVERLAP_SENTINEL + "new words here"]

    def expected(text):
        words, taken, held = text.split(C.OVERLAP_SENTINEL)[-1].split(" "), [], 0
        while words and held + tokens(words[-1] + " ") <= 5:
            held += tokens(words[-1] + " ")
            taken.insert(0, words.pop())
        return " ".join(taken)

    assert column_of(spark, texts, C.overlap_tail(F.col("x"), 5)) == [expected(t) for t in texts]


def test_strip_overlap_is_literal(spark):
    s = C.OVERLAP_SENTINEL
    assert column_of(spark, ["a" + s + "b" + s + "c", "plain"], C.strip_overlap(F.col("x"))) == ["b" + s + "c", "plain"]


def test_chunks_of_a_document(spark):
    text = "# Head\n\n" + "one two three four five six seven eight nine ten.\n\n- item one\n\n# Next\n\nlast words"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = C.chunk_documents(df, "doc_id", B.text_blocks(F.col("text")), SMALL).orderBy("block_index", "chunk_index").collect()
    assert [r.chunk_id for r in rows] == ["d::0::0", "d::1::0", "d::1::1", "d::1::2", "d::2::0", "d::3::0", "d::4::0"]
    assert [r.total_chunks for r in rows] == [1, 3, 3, 3, 1, 1, 1]
    assert [r.has_overlap for r in rows] == [False, False, True, True, True, False, False]
    assert all(r.content_with_overlap.endswith(r.content) for r in rows)
    assert C.OVERLAP_SENTINEL not in "".join(r.content for r in rows)


def test_unknown_block_type_fails(spark):
    df = spark.createDataFrame([("table",)], "k string")
    with pytest.raises(Exception, match="cannot split block type table"):
        df.select(C.require_splittable(F.col("k"))).collect()


@pytest.mark.parametrize("sentinel", [C.OVERLAP_SENTINEL, "aba", "=-="])
def test_plain_chunks_equal_chunks_behind_their_overlap(spark, sentinel):
    texts = ["one two three.\n\nfour five six. seven eight nine ten eleven.\n\n# Head\n\nlast", "", None, "x aba y\n\nab aba\n\nba ab\n\nends in =-\n\n= starts a=-=b=-=c\n\nab\n\na"]
    texts.append("tail\n---context-overlap---\n\nnext ---context-overlap---\n\nafter")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    blocks = B.text_blocks(F.col("text"))
    # Blocks that hold the sentinel itself, as blocks from elsewhere may.
    held = F.transform(blocks, lambda b: b.withField("content", F.replace(b["content"], F.lit("---context-overlap---"), F.lit(sentinel))))
    for made in (blocks, held):
        config = C.ChunkConfig(target_tokens=5, max_tokens=6, overlap_tokens=4, sentinel=sentinel)
        whole = C.chunk_documents(df, "doc_id", made, config).select("chunk_id", "content", "doc_id", "content_type")
        assert sorted(C.plain_chunks(df, "doc_id", made, config).collect()) == sorted(whole.collect())


def test_plain_chunks_make_no_overlap(spark, monkeypatch):
    monkeypatch.setattr(C, "overlap_tail", lambda *_: F.raise_error(F.lit("an overlap was made")).cast("string"))
    df = spark.createDataFrame([(1, "one two\n\nthree four\n\nfive")], "doc_id int, text string")
    assert [r.content for r in C.plain_chunks(df, "doc_id", B.text_blocks(F.col("text"))).collect()] == ["one two", "three four", "five"]
