"""Blocks to chunks under token budgets.

All folds run over the parts of one row and carry only cut positions, so a
document of n words costs O(n) and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import let, strip, token_count, word_weight
from quarrylens.operators.blocks import clean_cell, parse_markdown_table, serialize_table
from quarrylens.operators.unfold import unfold

# Fixed values -------------------------------------------------------------
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ")
OVERLAP_SENTINEL = "\n\n---context-overlap---\n\n"
OVERLAPPABLE = ("prose", "list_item")
SPLITTABLE = ("prose", "list_item", "heading")
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class ChunkConfig:
    doc_type: str = "pdf"
    target_tokens: int = 600
    max_tokens: int = 800
    table_max_tokens: int = 750
    overlap_tokens: int = 100
    sentinel: str = OVERLAP_SENTINEL
    separators: tuple[str, ...] = SEPARATORS

    def __post_init__(self) -> None:
        if self.target_tokens > self.max_tokens:
            raise ValueError("target_tokens may not exceed max_tokens")


def _literal_pattern(text: str) -> str:
    return r"\Q" + text + r"\E"


def _cuts_zero() -> Column:
    """State of a cut fold: finished cuts, open start, open size, position."""
    return F.struct(
        F.array().cast("array<struct<start:int,size:int>>").alias("cuts"),
        F.lit(1).alias("start"),
        F.lit(0).cast("bigint").alias("held"),
        F.lit(0).alias("pos"),
    )


def _cut(state: Column, last: Column) -> Column:
    return F.struct(state["start"].alias("start"), (last - state["start"] + 1).alias("size"))


def _state(cuts: Column, start: Column, held: Column, pos: Column) -> Column:
    return F.struct(
        cuts.alias("cuts"), start.cast("int").alias("start"), held.cast("bigint").alias("held"), pos.cast("int").alias("pos")
    )


def greedy_merge(parts: Column, separator: str, target_tokens: int) -> Column:
    """Join consecutive parts while the joined text stays within the target.

    Separators disappear where a chunk ends, and empty parts ahead of the
    first non-empty part of a chunk are swallowed.
    """
    gap = len(separator)
    fits = lambda length: F.floor(length / 4) + 1 <= target_tokens

    def step(s: Column, part: Column) -> Column:
        pos = s["pos"] + 1
        size = F.length(part).cast("bigint")
        open_ = s["held"] > 0
        grown = F.when(open_, s["held"] + gap + size).otherwise(size)
        flushed = F.when(open_, F.concat(s["cuts"], F.array(_cut(s, s["pos"])))).otherwise(s["cuts"])
        extend = fits(grown)
        return _state(
            F.when(extend, s["cuts"]).otherwise(flushed),
            F.when(extend & open_, s["start"]).otherwise(pos),
            F.when(extend, grown).otherwise(size),
            pos,
        )

    def close(s: Column) -> Column:
        return F.when(s["held"] > 0, F.concat(s["cuts"], F.array(_cut(s, s["pos"])))).otherwise(s["cuts"])

    def merged(ps: Column) -> Column:
        cuts = F.aggregate(ps, _cuts_zero(), step, close)
        return F.transform(cuts, lambda c: F.array_join(F.slice(ps, c["start"], c["size"]), separator))

    return let(parts, merged)


def hard_split(text: Column, target_tokens: int) -> Column:
    """Pack words greedily; weights of word plus blank add up to the target."""

    def step(s: Column, word: Column) -> Column:
        pos = s["pos"] + 1
        weight = word_weight(word)
        overflow = (s["held"] + weight > target_tokens) & (s["held"] > 0)
        return _state(
            F.when(overflow, F.concat(s["cuts"], F.array(_cut(s, s["pos"])))).otherwise(s["cuts"]),
            F.when(overflow, pos).otherwise(s["start"]),
            F.when(overflow, weight).otherwise(s["held"] + weight),
            pos,
        )

    def packed(words: Column) -> Column:
        cuts = F.aggregate(words, _cuts_zero(), step, lambda s: F.concat(s["cuts"], F.array(_cut(s, s["pos"]))))
        return F.transform(cuts, lambda c: F.array_join(F.slice(words, c["start"], c["size"]), " "))

    return let(F.split(text, " "), packed)


def recursive_split(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Split an oversize text at the coarsest separator it holds, then finer.

    A piece that is still too large is one part without the separators tried
    so far, hence one pass per separator and a final pass over words.
    """
    limit = config.max_tokens

    def split_pieces(pieces: Column, separator: str) -> Column:
        def finer(piece: Column) -> Column:
            parts = F.split(piece, _literal_pattern(separator))
            oversize = (token_count(piece) > limit) & F.contains(piece, F.lit(separator))
            return F.when(oversize, greedy_merge(parts, separator, config.target_tokens)).otherwise(F.array(piece))

        return F.flatten(F.transform(pieces, finer))

    def cascade(whole: Column) -> Column:
        pieces = F.array(whole)
        for separator in config.separators:
            pieces = split_pieces(pieces, separator)
        pieces = F.flatten(
            F.transform(
                pieces,
                lambda p: F.when(token_count(p) > limit, hard_split(p, config.target_tokens)).otherwise(F.array(p)),
            )
        )
        kept = F.filter(F.transform(pieces, strip), lambda p: p != "")
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(whole)))

    return F.when(token_count(text) <= limit, F.array(text)).otherwise(let(text, cascade))


def table_split(text: Column, max_tokens: int = ChunkConfig.table_max_tokens) -> Column:
    """Split an oversize markdown table by rows, repeating the header row.

    The size of a serialized table is additive in its rows once every row is
    padded to the same width, so the fold needs row lengths only.
    """

    def cell_chars(row: Column) -> Column:
        return F.aggregate(row, F.lit(0), lambda total, cell: total + F.length(clean_cell(cell)))

    def rows_to_chunks(rows: Column) -> Column:
        sizes = F.transform(rows, lambda r: F.struct(cell_chars(r).alias("chars"), F.size(r).alias("width")))

        def grow(s: Column, r: Column) -> Column:
            # A line of w cells is its cells plus 3w + 1; the rule line is all
            # dashes, 6w + 1; line breaks join them.
            width = F.greatest(s["width"], r["width"])
            body = s["body"] + r["chars"]
            lines = s["lines"] + 1
            total = body + lines * (3 * width + 1) + (6 * width + 1) + lines
            return F.struct(
                width.alias("width"),
                body.cast("bigint").alias("body"),
                lines.cast("bigint").alias("lines"),
                total.cast("bigint").alias("total"),
            )

        def chunks(measured: Column) -> Column:
            header = F.element_at(measured, 1)
            nothing = F.struct(
                F.lit(0).alias("width"),
                F.lit(0).cast("bigint").alias("body"),
                F.lit(0).cast("bigint").alias("lines"),
                F.lit(0).cast("bigint").alias("total"),
            )
            start = F.struct(
                F.array().cast("array<struct<start:int,size:int>>").alias("cuts"),
                F.lit(2).alias("start"),
                F.lit(1).alias("pos"),
                grow(nothing, header).alias("held"),
            )

            def step(s: Column, r: Column) -> Column:
                grown = grow(s["held"], r)
                pos = s["pos"] + 1
                has_body = s["held"]["lines"] > 1
                overflow = (F.floor(grown["total"] / 4) + 1 > max_tokens) & has_body
                fresh = grow(grow(nothing, header), r)
                return F.struct(
                    F.when(
                        overflow,
                        F.concat(s["cuts"], F.array(F.struct(s["start"].alias("start"), (pos - s["start"]).alias("size")))),
                    )
                    .otherwise(s["cuts"])
                    .alias("cuts"),
                    F.when(overflow, pos).otherwise(s["start"]).cast("int").alias("start"),
                    pos.cast("int").alias("pos"),
                    F.when(overflow, fresh).otherwise(grown).alias("held"),
                )

            def close(s: Column) -> Column:
                return F.concat(
                    s["cuts"],
                    F.array(F.struct(s["start"].alias("start"), (s["pos"] - s["start"] + 1).alias("size"))),
                )

            cuts = F.aggregate(F.slice(measured, 2, F.greatest(F.size(measured) - 1, F.lit(0))), start, step, close)
            return F.transform(
                cuts,
                lambda c: serialize_table(F.concat(F.slice(rows, 1, 1), F.slice(rows, c["start"], c["size"]))),
            )

        return let(sizes, chunks)

    def split_rows(rows: Column) -> Column:
        return F.when(F.size(rows) < 2, F.array(text)).otherwise(rows_to_chunks(rows))

    return F.when(token_count(text) <= max_tokens, F.array(text)).otherwise(let(parse_markdown_table(text), split_rows))


def overlap_tail(text: Column, budget: int = ChunkConfig.overlap_tokens, sentinel: str = OVERLAP_SENTINEL) -> Column:
    """Last words of a text whose weights stay within the budget.

    A word and its blank weigh more than a quarter of their characters, so no
    tail within the budget is longer than four times the budget: only that end
    of the text is cut into words.  A word cut by this limit never fits.
    """

    def tail(words: Column) -> Column:
        near = F.reverse(words)
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("held"), F.lit(True).alias("open"))

        def step(s: Column, word: Column) -> Column:
            held = s["held"] + word_weight(word)
            takes = s["open"] & (held <= budget)
            return F.struct(
                (s["n"] + takes.cast("int")).alias("n"),
                F.when(takes, held).otherwise(s["held"]).alias("held"),
                takes.alias("open"),
            )

        taken = F.aggregate(near, zero, step, lambda s: s["n"])
        return let(taken, lambda n: F.when(n > 0, F.array_join(F.slice(words, F.size(words) - n + 1, n), " ")).otherwise(""))

    clean = F.substring_index(text, sentinel, -1)
    return let(F.split(F.right(clean, F.lit(4 * budget + 2)), " "), tail)


def strip_overlap(text: Column, sentinel: str = OVERLAP_SENTINEL) -> Column:
    """Text after the first sentinel, or all of it."""
    at = F.instr(text, F.lit(sentinel))
    return F.when(at > 0, F.substring(text, at + len(sentinel), F.length(text))).otherwise(text)


def may_overlap(chunk: Column, previous: Column) -> Column:
    """Both running text, same section; null sections equal each other."""
    return (
        chunk["content_type"].isin(*OVERLAPPABLE)
        & previous["content_type"].isin(*OVERLAPPABLE)
        & chunk["section_header"].eqNullSafe(previous["section_header"])
    )


def split_block(block: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Texts of one block, by block type; other types stay whole."""
    return (
        F.when(block["block_type"] == "table", table_split(block["content"], config.table_max_tokens))
        .when(block["block_type"].isin(*OVERLAPPABLE), recursive_split(block["content"], config))
        .otherwise(F.array(block["content"]))
    )


def _split_blocks(blocks: Column, config: ChunkConfig) -> Column:
    """Chunks of one document, in order, without what they share with the chunk before."""

    def of_block(block: Column) -> Column:
        def numbered(texts: Column) -> Column:
            # Splitting clears the table index of running text only.
            was_split = (F.size(texts) > 1) & (block["block_type"] != "table")
            return F.transform(
                texts,
                lambda t, i: F.struct(
                    t.alias("content"),
                    block["block_type"].alias("content_type"),
                    block["page_number"].alias("page_number"),
                    block["section_header"].alias("section_header"),
                    F.when(~was_split, block["table_index"]).alias("table_index"),
                    block["block_index"].alias("block_index"),
                    i.cast("int").alias("chunk_index"),
                    F.size(texts).alias("total_chunks"),
                ),
            )

        return let(split_block(block, config), numbered)

    return F.flatten(F.transform(blocks, of_block))


def _tail_before(chunk: Column, previous: Column, i: Column, config: ChunkConfig) -> Column:
    """The end of the previous chunk that a chunk repeats, or an empty text."""
    return F.when(
        F.coalesce(may_overlap(chunk, previous) & (i > 0), F.lit(False)),
        overlap_tail(previous["content"], config.overlap_tokens, config.sentinel),
    ).otherwise("")


def _overlapped(chunk: Column, tail: Column, config: ChunkConfig) -> Column:
    return F.when(strip(tail) != "", F.concat(tail, F.lit(config.sentinel), chunk["content"])).otherwise(chunk["content"])


def chunk_array(blocks: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Chunks of one document, in order, from its array of blocks."""

    def with_overlap(chunks: Column) -> Column:
        def place(chunk: Column, i: Column) -> Column:
            tail = _tail_before(chunk, F.get(chunks, i - 1), i, config)
            return let(
                tail,
                lambda t: F.struct(
                    chunk["content"].alias("content"),
                    _overlapped(chunk, t, config).alias("content_with_overlap"),
                    chunk["content_type"].alias("content_type"),
                    chunk["page_number"].alias("page_number"),
                    chunk["section_header"].alias("section_header"),
                    chunk["table_index"].alias("table_index"),
                    chunk["block_index"].alias("block_index"),
                    chunk["chunk_index"].alias("chunk_index"),
                    chunk["total_chunks"].alias("total_chunks"),
                ),
            )

        return F.transform(chunks, place)

    return let(_split_blocks(blocks, config), with_overlap)


def plain_chunk_array(blocks: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Content, content_type, block_index and chunk_index of the same chunks, no overlap made.

    A text behind its overlap and the sentinel is the chunk's own, unless the
    sentinel occurs earlier: then the chunk or the one before holds what is left
    of the sentinel without its longest border, and the text is cut as elsewhere.
    """
    mark = config.sentinel
    border = max((n for n in range(len(mark)) if mark[:n] == mark[len(mark) - n :]), default=0)
    core = F.lit(mark[: len(mark) - border])

    def plain(chunks: Column) -> Column:
        def place(chunk: Column, i: Column) -> Column:
            previous = F.get(chunks, i - 1)
            marked = F.coalesce(F.contains(chunk["content"], core), F.lit(False)) | F.coalesce(F.contains(previous["content"], core), F.lit(False))
            cut = strip_overlap(_overlapped(chunk, _tail_before(chunk, previous, i, config), config), config.sentinel)
            return F.struct(
                F.when(marked, cut).otherwise(chunk["content"]).alias("content"),
                chunk["content_type"].alias("content_type"),
                chunk["block_index"].alias("block_index"),
                chunk["chunk_index"].alias("chunk_index"),
            )

        return F.transform(chunks, place)

    return let(_split_blocks(blocks, config), plain)


def chunk_documents(df: DataFrame, doc_id: str, blocks: Column, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row per chunk.  Map-only: no exchange between the scan and the sink."""
    doc = F.col(doc_id).cast("string")
    has_overlap = F.contains(F.col("content_with_overlap"), F.lit(config.sentinel))
    content = strip_overlap(F.col("content_with_overlap"), config.sentinel)
    rows = unfold(df, [doc.alias("doc_id")], chunk_array(blocks, config), "c").select("doc_id", "c.*")
    return rows.select(
        F.concat_ws("::", "doc_id", "block_index", "chunk_index").alias("chunk_id"),
        content.alias("content"),
        "content_with_overlap",
        "doc_id",
        F.lit(config.doc_type).alias("doc_type"),
        "page_number",
        "section_header",
        "table_index",
        "block_index",
        "chunk_index",
        "total_chunks",
        "content_type",
        has_overlap.alias("has_overlap"),
        token_count(content).cast("int").alias("token_count"),
        F.current_timestamp().alias("ingested_at"),
    )


def plain_chunks(df: DataFrame, doc_id: str, blocks: Column, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """chunk_id, content, doc_id and content_type as in :func:`chunk_documents`, for readers of these alone."""
    rows = unfold(df, [F.col(doc_id).cast("string").alias("doc_id")], plain_chunk_array(blocks, config), "c")
    return rows.select(F.concat_ws("::", "doc_id", "c.block_index", "c.chunk_index").alias("chunk_id"), "c.content", "doc_id", "c.content_type")


def chunk_record() -> Column:
    """Nested form of a chunk row."""
    return F.struct(
        F.col("chunk_id"),
        F.col("content"),
        F.col("content_with_overlap"),
        F.struct(
            "doc_id", "doc_type", "page_number", "section_header", "table_index", "block_index",
            "chunk_index", "total_chunks", "content_type", "has_overlap", "token_count", "ingested_at",
        ).alias("metadata"),
    )


def require_splittable(kind: Column) -> Column:
    """Fail the job on a block type the prose splitter does not accept."""
    return F.assert_true(kind.isin(*SPLITTABLE), F.concat(F.lit("cannot split block type "), kind))
