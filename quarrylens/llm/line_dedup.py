"""Line dedup that can take documents in and out again.

Three tables make the state:

* ``postings``: (key, doc_id), one row for each long line key of a document;
* ``counts``: (key, n_docs, last_doc), the exact reference counts;
* ``filters``: one cuckoo filter for each shard of keys, holding the keys
  that are repeated just now.

Taking documents in or out changes the counts of their keys only; a key that
becomes repeated enters its shard's filter, one that no longer is leaves it.
Undoing a change restores the decisions of before.  A filter spares lines that
are not repeated the exact join; what passes it is decided by the counts.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case, held as 128 bits of its SHA-256.  A null or empty text is one empty
line, and stays.  Rows without doc_id count as no document and stay whole.
Rows that repeat a doc_id are one document: its keys are counted once, and the
decision on a key holds for all its rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.cuckoo import CuckooFilter, filter_of, key_words
from quarrylens.llm.shared import settle

LEAST_CHARS = 40
LEAST_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARDS = 64
NEW_COLUMNS = ("kept_text", "n_lines", "n_dropped")
# Filters of more bytes are not shipped to the tasks; the exact join then takes all lines.
SHIPPED_BYTES = 64 << 20


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    least_docs: int
    shards: int


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def digest(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


_LOWERED = str.maketrans(UPPER, LOWER)


def python_digest(line: str, least_chars: int) -> bytes | None:
    """The digest of a line's key, None when the key is short."""
    key = line.strip(SPACE)
    return hashlib.sha256(key.translate(_LOWERED).encode()).digest()[:16] if len(key) >= least_chars else None


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, key) for the distinct long keys of every row."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    keys = F.transform(lines, line_key)
    held = F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= least_chars), digest))
    rows = docs.filter("doc_id is not null").select("doc_id", F.explode_outer(held).alias("key"))
    return rows.filter("key is not null")


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


FILTER_SCHEMA = "shard int, n_keys long, slots binary"


def _built(counts: DataFrame, least_docs: int, shards: int) -> DataFrame:
    """One filter for each shard that has repeated keys."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(bytes(k) for k in rows["key"])
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n_keys": [len(keys)], "slots": [filter_of(keys).to_bytes()]})

    repeated = _sharded(counts.filter(F.col("n_docs") >= least_docs).select("key"), shards)
    return repeated.groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def build_index(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shards: int = SHARDS
) -> LineIndex:
    """The state of a first set of documents."""
    # Distinct (key, document) first: a key that most documents hold is spread
    # by the documents, and then arrives at its count as one row for each task.
    postings = settle(long_lines(docs, least_chars).distinct(), "postings")
    counts = settle(_counted(postings), "line-counts")
    return LineIndex(postings, counts, settle(_built(counts, least_docs, shards), "filters"), least_docs, shards)


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The state after ``postings`` replaced the former ones; only ``touched`` keys differ."""
    postings = settle(postings, "postings")
    touched = settle(touched.select("key").distinct(), "touched")
    fresh = _counted(postings.join(touched, "key", "left_semi"))
    counts = settle(index.counts.join(touched, "key", "left_anti").unionByName(fresh), "line-counts")
    least = index.least_docs

    def repeated(c: DataFrame, name: str) -> DataFrame:
        return c.join(touched, "key", "left_semi").select("key", (F.col("n_docs") >= least).alias(name))

    before, after = repeated(index.counts, "was"), repeated(counts, "now")
    moves = before.join(after, "key", "full").select(
        "key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now")
    )
    moves = _sharded(moves.filter("was != now"), index.shards)
    all_keys = _sharded(counts.filter(F.col("n_docs") >= least).select("key"), index.shards)

    def move(_: tuple, held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return held
        gone = sorted(bytes(k) for k in rows.loc[~rows["now"], "key"])
        new = sorted(bytes(k) for k in rows.loc[rows["now"], "key"])
        kept = CuckooFilter.of_bytes(bytes(held["slots"].iloc[0])) if len(held) else CuckooFilter.sized(len(new))
        size = (int(held["n_keys"].iloc[0]) if len(held) else 0) - len(gone) + len(new)
        if gone:
            kept.delete(key_words(gone))
        full = bool(new) and not kept.insert(key_words(new))
        # A filter too full is built again from the exact counts.
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n_keys": [size], "slots": [b"" if full else kept.to_bytes()]})

    moved = settle(index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(move, FILTER_SCHEMA), "filters")
    full = moved.filter(F.length("slots") == 0).select("shard")
    if not full.isEmpty():
        again = counts.join(_sharded(all_keys.drop("shard"), index.shards).join(full, "shard", "left_semi"), "key", "left_semi")
        moved = settle(moved.filter(F.length("slots") > 0).unionByName(_built(again, least, index.shards)), "filters")
    return LineIndex(postings, counts, moved, least, index.shards)


def insert_documents(index: LineIndex, docs: DataFrame, least_chars: int = LEAST_CHARS) -> LineIndex:
    """The state with further documents."""
    fresh = settle(long_lines(docs, least_chars).distinct(), "fresh")
    return _changed(index, index.postings.unionByName(fresh).distinct(), fresh)


def delete_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The state without the documents whose doc_id is in ``ids``."""
    gone = ids.select("doc_id").distinct()
    touched = index.postings.join(gone, "doc_id", "left_semi")
    return _changed(index, index.postings.join(gone, "doc_id", "left_anti"), touched)


def _probed(lines: DataFrame, index: LineIndex) -> DataFrame:
    """The lines whose key may be repeated."""
    size = index.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
    if size > SHIPPED_BYTES:
        return lines
    held = {row.shard: bytes(row.slots) for row in index.filters.select("shard", "slots").collect()}
    shipped = lines.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def may_repeat(keys: pd.Series, shards: pd.Series) -> pd.Series:
        words = key_words([bytes(k) for k in keys])
        out = np.zeros(len(keys), dtype=bool)
        numbers = shards.to_numpy()
        for shard in np.unique(numbers):
            slots = shipped.value.get(int(shard))
            if slots:
                at = np.flatnonzero(numbers == shard)
                out[at] = CuckooFilter(np.frombuffer(slots, np.uint16).reshape(-1, 4)).contains(words[at])
        return pd.Series(out)

    return _sharded(lines, index.shards).filter(may_repeat("key", "shard")).drop("shard")


def repeated_keys(docs: DataFrame, index: LineIndex, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, drop): the keys that each document loses."""
    candidates = _probed(long_lines(docs, least_chars), index)
    repeated = index.counts.filter(F.col("n_docs") >= index.least_docs).select("key", "last_doc")
    lost = candidates.join(repeated, "key").filter(F.col("doc_id") < F.col("last_doc"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def drop_repeated_lines(docs: DataFrame, index: LineIndex, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The columns of ``docs`` and, last, the kept text and the numbers of lines and of dropped lines.

    These are named kept_text, n_lines and n_dropped, with as many underscores
    in front as it takes not to clash with ``docs``.
    """
    mark = f"_drop_{uuid.uuid4().hex[:8]}"
    front = ""
    while {front + c for c in NEW_COLUMNS} & {c.lower() for c in docs.columns}:
        front += "_"
    added = [front + c for c in NEW_COLUMNS]
    lost = repeated_keys(docs, index, least_chars).select(F.col("doc_id").alias(f"{mark}_id"), F.col("drop").alias(mark))
    met = docs.join(lost, docs["doc_id"] == lost[f"{mark}_id"], "left").drop(f"{mark}_id")
    names = docs.columns
    at, drops = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for cell, lost_keys in zip(batch.column(at), batch.column(drops)):
                text = cell.as_py() or ""
                gone = set(lost_keys.as_py() or ())
                if not gone:
                    kept.append(text)
                    lines.append(text.count("\n") + 1)
                    dropped.append(0)
                    continue
                parts = text.split("\n")
                left = [line for line in parts if python_digest(line, least_chars) not in gone]
                kept.append("\n".join(left))
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            columns = [batch.column(k) for k in range(drops)] + [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    zero = F.lit(0).cast("long")
    schema = docs.select("*", *[c.alias(name) for c, name in zip((F.lit(""), zero, zero), added)]).schema
    return met.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shards: int = SHARDS) -> DataFrame:
    """The documents' rows against the index of all of them."""
    return drop_repeated_lines(docs, build_index(docs, least_chars, least_docs, shards), least_chars)
