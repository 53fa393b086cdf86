"""Exact token counts for every context limit from a length histogram.

Documents are encoded where they lie and only their lengths are kept; equal
lengths are added up before anything is shuffled.  Suffix sums over the
histogram then answer, for every limit, how many documents are longer, how
many tokens they hold, what a cut at the limit keeps, and which quantile the
limit is.

A null or empty text has length 0.  Repeated rows count once each.  An empty
table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.bpe import default_vocabulary, load_bpe
from quarrylens.llm.shared import settle

# Lengths summed up together; sums over such blocks come first.
BLOCK = 1024


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            counts = [len(bpe.encode_bytes(cell.as_py())) // 4 for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs, and the smallest and largest doc_id of that length."""
    return lengths.groupBy(F.col(length).alias("n_tokens")).agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row per length that occurs, as a context limit.

    docs_longer and tokens_longer speak of documents beyond the limit,
    truncated_total is what remains when every document is cut at the limit,
    quantile the share of documents within it.  For a limit that does not
    occur, the row of the next longer length tells the documents beyond it.
    """
    docs, tokens = F.col("n_docs"), F.col("n_docs") * F.col("n_tokens")
    cells = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = cells.groupBy("block").agg(F.sum(docs).alias("b_docs"), F.sum(tokens).alias("b_tokens"))
    # One row per block of lengths: as many as the longest text has thousands of tokens.
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("after_docs"),
        F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("after_tokens"),
        F.sum("b_docs").over(whole).alias("all_docs"),
        F.sum("b_tokens").over(whole).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.join(sums, "block").select(
        "*",
        (F.col("after_docs") + F.coalesce(F.sum(docs).over(longer), F.lit(0))).alias("docs_longer"),
        (F.col("after_tokens") + F.coalesce(F.sum(tokens).over(longer), F.lit(0))).alias("tokens_longer"),
    )
    kept = F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return rows.select(
        *histogram.columns,
        "docs_longer",
        "tokens_longer",
        "all_docs",
        "all_tokens",
        kept.alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length within which at least each share of the documents lies."""
    wanted = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    points = sums.select("n_tokens", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), "quantile")
    best = points.filter(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    return wanted.join(best, "share", "left")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_longer, truncated_total for any limits, occurring or not."""
    cells = sums.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
    return cells.groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("truncated_total"),
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The suffix sums of a table of documents."""
    # Blocks and cells both read the histogram; texts are encoded once.
    return suffix_sums(settle(length_histogram(token_lengths(docs, vocabulary)), "lengths"))
