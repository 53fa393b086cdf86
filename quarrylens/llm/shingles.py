"""Hashes of words and word shingles of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
# Bytes hashed together; longer texts are hashed in such pieces, cut at white space.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_ONE = np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(size, _BASE, dtype=np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no linear traces."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a piece."""
    size = 1 << max(PIECE.bit_length(), int(len(raw) + 1).bit_length())
    up, down = _powers(size)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    # Bytes count from 1, so that zero bytes matter too.
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + _ONE) * up[: len(raw)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word, a run without ASCII white space."""
    codes = np.frombuffer(raw, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(codes):
        stop = min(len(codes), at + PIECE)
        if stop < len(codes):
            # Back to the last blank; a longer word moves the cut behind it.
            blanks = np.flatnonzero(_SPACE[codes[at:stop]])
            if len(blanks):
                stop = at + int(blanks[-1]) + 1
            else:
                rest = next((p for p in range(stop, len(codes)) if _SPACE[codes[p]]), len(codes))
                stop = rest
        s, h = _piece_hashes(codes[at:stop])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """Texts in lower case behind one another, and where each begins."""
    parts = [(t or "").encode().lower() for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return b"\n".join(parts), offsets


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text.

    A text with fewer words than a shingle has one for the whole sequence, a
    text without words none.
    """
    raw, offsets = joined(texts)
    starts, words = word_hashes(raw)
    bounds = np.searchsorted(starts, offsets)
    factor = np.uint64(0xA0761D6478BD642F)
    out = []
    if len(words) >= SHINGLE:
        rolled = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * factor + words[k : k + len(rolled)]
        rolled = mixed(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = b - a
            for w in words[a:b].tolist():
                whole = (whole * int(factor) + w) % (1 << 64)
            out.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut after ``rows`` rows or about ``size`` bytes of the text column; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop
