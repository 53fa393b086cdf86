"""Near-duplicate documents by SimHash, compared in vertical bit planes.

1. A document's fingerprint has 64 bits: bit b is 1 if it is 1 in more than half
   of the hashes of its three-word shingles, repeats included.
2. Equal fingerprints are one form, so a page copied any number of times is one
   row from here on.
3. Two forms that differ in at most r bits agree in at least one of r + 1 bands
   of the bits.  Forms are dealt to buckets by (band, its bits).  A bucket of more
   than ``BUCKET`` forms is dealt again by bands of the bits that are still free;
   the same holds there, so no link is lost, and when few bits are free a bucket
   is small: it cannot hold more than 2**free different forms.
4. In a bucket, 64 forms make a block: bit b of all of them is one machine word of
   plane b.  A form meets a block by one exclusive or for each plane, which feeds
   64 bitwise counters with carry-save additions.  The counters start where the
   first distance beyond the radius overflows; a block is abandoned as soon as
   all of its counters have.
5. Links become components by alternating large-star and small-star.

Null and empty texts, and texts without words, have fingerprint zero and are
linked like any other.  Each row counts for itself: rows that repeat a doc_id
have their own fingerprints.  A component's id is its smallest doc_id; rows
without doc_id belong to components and do not name them (null if no row does).
An empty table gives no rows.  Other columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.components import components
from quarrylens.llm.shared import join_weighted, settle
from quarrylens.llm.shingles import slices

SHINGLE = 3
BITS = 64
RADIUS = 2
SEED = 42
# Forms of a bucket that are compared; a larger one is dealt again by more bits.
BUCKET = 4096
# Bits left free when a bucket is compared whatever its size.
FREE_BITS = 14
# Rows compared together, and (form, block) meetings worked on at once.
ROWS_HELD, MEETINGS = 1 << 15, 1 << 16
# Planes between two looks at which blocks can be abandoned.
PLANES_BETWEEN = 8
# Texts, and bytes of them, fingerprinted together; hashes counted together.
TEXTS, TEXT_BYTES, HASHES = 1024, 4 << 20, 1 << 14

_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text; zero without words."""
    raw = _BLANKS.sub(b" ", (text or "").encode().lower()).strip(b" ")
    if not raw:
        return 0
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    width = min(SHINGLE, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), HASHES):
        spans = zip(starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, form) of every row; the form is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, TEXTS, TEXT_BYTES):
            forms = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms.view(np.int64))], ["doc_id", "form"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, form long")


def bit_planes(forms: np.ndarray) -> np.ndarray:
    """(64, blocks): bit b of 64 forms behind one another as one word; missing forms are zero."""
    padded = np.zeros(-(-len(forms) // 64) * 64, dtype="<u8")
    padded[: len(forms)] = forms
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def close_pairs(forms: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of rows a < b < ends[a] within the radius, and the planes that blocks were met on.

    ``ends`` is, for each form, where its bucket stops.
    """
    planes = bit_planes(forms)
    rows = np.arange(len(forms))
    first = (rows + 1) // 64
    blocks = np.where(ends > rows + 1, (ends - 1) // 64 - first + 1, 0)
    upto = np.cumsum(blocks)
    left, right, met, at = [], [], 0, 0
    while at < len(forms):
        done = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + MEETINGS, side="right")))
        count = blocks[at:stop]
        form = np.repeat(rows[at:stop], count)
        block = np.repeat(first[at:stop] - (upto[at:stop] - count - done), count) + np.arange(len(form))
        form, near, block, planes_met = _meet(planes, forms, form, block, radius)
        met += planes_met
        bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        a, b = form[k], block[k] * 64 + bit
        kept = (b > a) & (b < ends[a])
        left.append(a[kept])
        right.append(b[kept])
        at = stop
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), met


def _meet(planes: np.ndarray, forms: np.ndarray, form: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What is left of the meetings: form, bits of the block's members in the radius, block; and planes met."""
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counters = [np.full(len(form), _ALL if start >> k & 1 else 0, dtype=np.uint64) for k in range(width)]
    over, own, met = np.zeros(len(form), dtype=np.uint64), forms[form], 0
    for b in range(BITS):
        met += len(form)
        carry = planes[b][block] ^ (np.uint64(0) - ((own >> np.uint64(b)) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % PLANES_BETWEEN == PLANES_BETWEEN - 1:
            live = np.flatnonzero(over != _ALL)
            if len(live) < len(form):
                form, block, own, over = form[live], block[live], own[live], over[live]
                counters = [c[live] for c in counters]
    return form, ~over, block, met


def least_members(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``size`` rows, the first row it is joined with by pairs."""
    least = np.arange(size)
    while True:
        before = least.copy()
        both = np.minimum(least[left], least[right])
        np.minimum.at(least, left, both)
        np.minimum.at(least, right, both)
        least = least[least]
        if (least == before).all():
            return least


def band_masks(radius: int = RADIUS, free_bits: int = FREE_BITS) -> list[list[tuple[int, int, int]]]:
    """For each depth, (path of the bucket above, path, mask of the agreed bits)."""
    depths, above = [], [(0, list(range(BITS)), 0)]
    while len(above[0][1]) > free_bits:
        below = []
        for path, free, mask in above:
            for k, band in enumerate(np.array_split(free, radius + 1)):
                agreed = mask | sum(1 << int(b) for b in band)
                below.append((path, path * (radius + 1) + k + 1, agreed, [b for b in free if b not in set(band.tolist())]))
        depths.append([(p, q, m) for p, q, m, _ in below])
        above = [(q, free, m) for _, q, m, free in below]
    return depths


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            cuts = np.concatenate(([0], change, [len(rows)]))
            ends = np.repeat(cuts[1:], np.diff(cuts))
            forms = rows[:, 2].copy()
            left, right, _ = close_pairs(forms.view(np.uint64), ends, radius)
            least = least_members(len(rows), left, right)
            joined = np.flatnonzero(least != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(forms[joined]), pa.array(forms[least[joined]])], ["u", "v"])

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1))
            if sum(map(len, held)) < ROWS_HELD:
                continue
            rows = np.concatenate(held)
            # The last bucket may go on in the next batch.
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            cut = int(change[-1]) if len(change) else 0
            held = [rows[cut:]]
            if cut:
                yield links(rows[:cut])
        if held:
            yield links(np.concatenate(held))

    return run


def form_links(forms: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, free_bits: int = FREE_BITS) -> DataFrame:
    """(u, v) that join all of the distinct (form) within the radius, by way of others or directly."""
    depths = band_masks(radius, free_bits)
    rows, links = forms.select("form", F.lit(0).cast("long").alias("path")), None
    for depth, bands in enumerate(depths):
        below = F.array(*[F.struct(F.lit(p).alias("above"), F.lit(q).cast("long").alias("path"), F.lit(_signed(m)).alias("mask")) for p, q, m in bands])
        cut = rows.select("form", F.explode(F.filter(below, lambda b: b["above"] == F.col("path"))).alias("band"))
        keyed = cut.select("band.path", F.col("form").bitwiseAND(F.col("band.mask")).alias("key"), "form")
        hot = None
        if depth + 1 < len(depths):
            sizes = settle(keyed.groupBy("path", "key").agg(F.count("*").alias("size")).filter(F.col("size") > bucket), "full-buckets")
            hot = sizes if sizes.head(1) else None
        cool = keyed if hot is None else join_weighted(keyed, hot, ["path", "key"], "size", "left_anti")
        dealt = cool.repartition("path", "key").sortWithinPartitions("path", "key")
        found = settle(dealt.mapInArrow(_linked(radius), "u long, v long"), "links")
        links = found if links is None else links.unionByName(found)
        if hot is None:
            return links
        rows = settle(join_weighted(keyed, hot, ["path", "key"], "size", "left_semi").select("form", "path"), "dealt-again")
    return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, free_bits: int = FREE_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of (doc_id, text)."""
    prints = settle(fingerprints(docs), "fingerprints")
    forms = settle(prints.groupBy("form").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "forms")
    linked = components(form_links(forms.select("form"), radius, bucket, free_bits))
    members = linked.select(F.col("id").alias("form"), "component").join(forms.select("form", "first"), "form")
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    named = members.select("form", "component").join(least, "component").select("form", "least", F.lit(True).alias("joined"))
    ids = forms.join(named, "form", "left").select("form", "rows", F.when(F.col("joined"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    out = join_weighted(prints, ids, ["form"], "rows", "inner")
    return out.select("doc_id", F.lpad(F.lower(F.hex("form")), 16, "0").alias("fingerprint"), "component_id")
