"""From raw documents to packed sequences.

Each stage takes what the one before kept and returns documents with the same
columns; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import line_dedup, minhash_dedup, packing, quality_rules, secret_scan
from quarrylens.llm.shared import settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with another text and, where present, its length."""
    columns = [F.col(text).alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in the last of them only."""
    rows = line_dedup.line_dedup(docs)
    return with_text(docs, rows, rows.columns[len(docs.columns)])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash_dedup.keep_one_of_each(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask."""
    return secret_scan.mask_secrets(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("line_dedup", fresh_lines),
    ("minhash_dedup", one_of_each),
    ("secret_scans", masked_secrets),
    ("packing", packed_sequences),
]

# The tokenizer has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
