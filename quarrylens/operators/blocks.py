"""Text to typed blocks.

A document is one row, so its blocks are an array in that row: splitting,
typing, numbering and the running section need no shuffle.  Block tables that
arrive as rows go through :mod:`quarrylens.operators.running` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import let, strip
from quarrylens.operators.running import running_aggregates
from quarrylens.operators.unfold import unfold

# Fixed values -------------------------------------------------------------
HEADING_MAX_CHARS = 120
# Optional numbering and a run of capitals up to a line end, or 1-4 hashes.
HEADING_PATTERN = r"\A(?:(?:\d+[.\d]*\s+)?[A-Z][A-Z\s\-/]{3,}(?md:$)|#{1,4}\s)"
LIST_PATTERN = r"\A(?:[*-]|\d+[.)]\s)"
TABLE_RULE_PATTERN = r"\A\|[\s\-|]+\|\z"
# --------------------------------------------------------------------------


def paragraphs(text: Column, every_line: bool = False) -> Column:
    """Trimmed, non-empty paragraphs; optionally each line is a paragraph."""
    separator = r"\n+" if every_line else r"\n{2,}"
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def is_heading(text: Column) -> Column:
    def test(t: Column) -> Column:
        return (F.length(t) <= HEADING_MAX_CHARS) & ~F.endswith(t, F.lit(".")) & t.rlike(HEADING_PATTERN)

    return let(strip(text), test)


def block_type(text: Column) -> Column:
    return (
        F.when(is_heading(text), "heading")
        .when(text.rlike(LIST_PATTERN), "list_item")
        .otherwise("prose")
    )


def text_blocks(text: Column, page: Column | None = None, every_line: bool = False) -> Column:
    """Array of blocks of one document, with the section carried forward."""
    page_number = (page if page is not None else F.lit(1)).cast("int")
    typed = F.transform(
        paragraphs(text, every_line),
        lambda p, i: F.struct(
            block_type(p).alias("block_type"),
            p.alias("content"),
            page_number.alias("page_number"),
            i.cast("int").alias("block_index"),
            F.lit(None).cast("int").alias("table_index"),
        ),
    )
    return carry_sections(typed)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def carry_sections(blocks: Column) -> Column:
    """Add ``section_header``: the text of the latest heading, itself included.

    Headings are located once; each repeats its text up to the next one, so
    the work grows with the number of blocks.
    """

    def placed(rows: Column, sections: Column) -> Column:
        return F.transform(
            rows,
            lambda block, i: F.struct(
                block["block_type"].alias("block_type"),
                block["content"].alias("content"),
                block["page_number"].alias("page_number"),
                block["block_index"].alias("block_index"),
                F.get(sections, i).alias("section_header"),
                block["table_index"].alias("table_index"),
            ),
        )

    def spread_out(rows: Column, heads: Column) -> Column:
        n = F.size(rows)
        before = F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get(heads, F.lit(0)), n))
        after = F.transform(heads, lambda h, k: F.array_repeat(F.get(rows, h)["content"], F.coalesce(F.get(heads, k + 1), n) - h))
        return F.flatten(F.concat(F.array(before), after))

    def all_of(rows: Column) -> Column:
        places = F.transform(rows, lambda block, i: F.when(block["block_type"] == "heading", i))
        return bound(F.array_compact(places), lambda heads: bound(spread_out(rows, heads), lambda sections: placed(rows, sections)))

    return bound(blocks, all_of)


def explode_blocks(df: DataFrame, doc_id: str, blocks: Column) -> DataFrame:
    return unfold(df, [F.col(doc_id).alias("doc_id")], blocks, "b").select("doc_id", "b.*")


def block_record(row_prefix: str = "", doc_type: str = "pdf") -> Column:
    """Nested form of a block row: type, content, metadata."""
    c = lambda name: F.col(row_prefix + name)
    return F.struct(
        c("block_type").alias("block_type"),
        c("content").alias("content"),
        F.struct(
            c("doc_id").alias("doc_id"),
            F.lit(doc_type).alias("doc_type"),
            c("page_number").alias("page_number"),
            c("section_header").alias("section_header"),
            c("table_index").alias("table_index"),
            c("block_index").alias("block_index"),
        ).alias("metadata"),
    )


def number_blocks(df: DataFrame, doc: str, position: str, kind: str, heading_text: str) -> DataFrame:
    """Number and section-fill a block table that is stored as rows.

    Adds 0-based ``block_index``, ``table_index`` (tables only) and
    ``section_header``.  Positions are bucketed, so even a document holding a
    large part of all rows is spread over many tasks.
    """
    is_table = F.col(kind) == "table"
    heading = F.when(F.col(kind) == "heading", F.struct(F.col(position).alias("at"), F.col(heading_text).alias("text")))
    out = running_aggregates(
        df,
        keys=[doc],
        order=position,
        bucket=F.floor(F.col(position) / 65536),
        sums={"_blocks": F.lit(1), "_tables": is_table.cast("int")},
        maxima={"_section": heading},
    )
    return out.select(
        *df.columns,
        (F.col("_blocks") - 1).alias("block_index"),
        F.when(is_table, F.col("_tables") - 1).alias("table_index"),
        F.col("_section.text").alias("section_header"),
    )


def clean_cell(cell: Column) -> Column:
    """Cell text as it stands in a table: pipes escaped, on one line."""
    escaped = F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.replace(strip(escaped), F.lit("\n"), F.lit(" "))


def serialize_table(rows: Column) -> Column:
    """Markdown text of a table given as an array of rows of cells."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(cleaned: Column) -> Column:
        width = F.array_max(F.transform(cleaned, lambda r: F.size(r)))
        padded = F.transform(cleaned, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        rule = line(F.array_repeat(F.lit("---"), width))
        lines = F.transform(padded, line)
        return F.array_join(
            F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))),
            "\n",
        )

    cleaned = F.transform(rows, lambda r: F.transform(r, clean_cell))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(let(cleaned, render))


def parse_markdown_table(text: Column) -> Column:
    """Rows of cells of the pipe lines; rule lines are dropped.

    Cells are cut at unescaped pipes, so an escaped pipe keeps its column and
    comes back as a plain one.
    """
    lines = F.filter(
        F.transform(F.split(text, r"\r\n|\n|\r"), strip),
        lambda l: F.startswith(l, F.lit("|")) & ~l.rlike(TABLE_RULE_PATTERN),
    )
    return F.transform(
        lines,
        lambda l: F.transform(
            F.split(F.regexp_replace(l, r"\A\|+|(?<!\\)\|+\z", ""), r"(?<!\\)\|"),
            lambda cell: F.replace(strip(cell), F.lit("\\|"), F.lit("|")),
        ),
    )
