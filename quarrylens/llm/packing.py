"""Packing of tokenized documents into sequences of one length.

Shortest-pack-first over the length histogram: lengths are placed longest
first, each into the packs that are shortest so far, for all pieces of that
length at once.  The plan is a list of packing patterns with counts; its size
depends on the sequence length only, never on the number of documents.  The
pieces are then numbered within their length and joined to the pattern slots
by that rank.

A null or empty text has the end token alone.  A document longer than a
sequence is cut at multiples of the sequence length, so each token lies in one
piece.  Repeated rows are packed once each; ties between equal pieces are
broken by doc_id, start and checksum.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.bpe import default_vocabulary, load_bpe
from quarrylens.llm.shared import settle

SEQUENCE = 1024
END_ID = 0
# Pieces numbered by one window group.
RANKED_TOGETHER = 1_000


def document_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for k, cell in enumerate(batch.column(1)):
                raw = bpe.encode_bytes(cell.as_py()) + end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    rows.append(k)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *numbers], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


@dataclass(frozen=True)
class Slot:
    """Ranks [first, last) of one length go into one pattern's sequences."""

    length: int
    first: int
    last: int
    sequence: int
    times: int
    offset: int


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Patterns (how often each length occurs in a sequence) with their numbers of sequences.

    Runs on the histogram, which has at most ``capacity`` entries.
    """
    open_packs: dict[int, list[list]] = {}  # free room -> [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                # New packs, each the shortest until it is full.
                most = capacity // length
                for times, count in ((most, left // most), (left % most, 1)):
                    if times and count:
                        open_packs.setdefault(capacity - times * length, []).append([Counter({length: times}), count])
                break
            pattern, count = open_packs[room][-1]
            used = min(count, left)
            if used == count:
                open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
            else:
                open_packs[room][-1][1] = count - used
            grown = pattern.copy()
            grown[length] += 1
            open_packs.setdefault(room - length, []).append([grown, used])
            left -= used
    return [(pattern, count) for room in sorted(open_packs) for pattern, count in open_packs[room]]


def pattern_slots(patterns: list[tuple[Counter, int]]) -> list[Slot]:
    """Where the pieces of each length go, by rank within the length."""
    slots: list[Slot] = []
    taken: Counter = Counter()
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            times = pattern[length]
            slots.append(Slot(length, taken[length], taken[length] + times * count, sequence, times, offset))
            taken[length] += times * count
            offset += times * length
        sequence += count
    return slots


def rank_within(pieces: DataFrame, key: str, order: list[str], total: int) -> DataFrame:
    """``rank`` from 0 among the rows of equal ``key``, gapless.

    A key may hold most rows: its rows are dealt over hashed groups of bounded
    size, numbered there, and shifted by the sizes of the groups before.
    """
    groups = max(1, -(-total // RANKED_TOGETHER))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    within = Window.partitionBy(key, "group")
    local = dealt.withColumn("place", F.row_number().over(within.orderBy(*order)) - 1)
    sizes = dealt.groupBy(key, "group").agg(F.count("*").alias("size"))
    before = Window.partitionBy(key).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "group", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    return local.join(shifts, [key, "group"]).withColumn("rank", F.col("shift") + F.col("place")).drop("group", "place", "shift")


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to a settled table of pieces."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows reach the driver.
    histogram = {row.length: row.n for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pattern_slots(packing_patterns(histogram, capacity))
    kind = "struct<first:long,last:long,sequence:long,times:long,offset:long>"
    by_length: dict[int, list[tuple]] = {}
    for s in slots:
        by_length.setdefault(s.length, []).append((s.first, s.last, s.sequence, s.times, s.offset))
    plan = spark.createDataFrame(list(by_length.items()), f"length long, slots array<{kind}>")
    ranked = rank_within(pieces, "length", ["doc_id", "start", "ids_crc32"], sum(histogram.values()))
    # The plan has one row per length and a few slots each: bounded by the capacity.
    met = ranked.join(F.broadcast(plan), "length")
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"]))[0]
    met = met.withColumn("slot", slot).withColumn("nth", F.col("rank") - F.col("slot.first"))
    times = F.col("slot.times")
    return met.select(
        *pieces.columns,
        (F.col("slot.sequence") + F.floor(F.col("nth") / times)).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + F.pmod(F.col("nth"), times) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """Every document's pieces with their sequences: tokenized once, packed by the histogram."""
    return pack_pieces(settle(document_pieces(docs, vocabulary, capacity), "pieces"), capacity)
