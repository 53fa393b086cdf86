"""The tokenizer of ``text.tokenize`` over Arrow arrays, for tasks that need the words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarrylens.functions.text import STRIPPED_PUNCTUATION, WHITESPACE

# Bytes of text that are looked at together; a longer text is looked at alone.
SLICE_BYTES = 4 << 20

_DROPPED, _SPACE, _TWO, _THREE = 1, 2, 3, 4
_WIDE = {n: [c.encode() for c in WHITESPACE if len(c.encode()) == n] for n in (2, 3)}
_KIND = np.zeros(256, np.uint8)
_KIND[list(STRIPPED_PUNCTUATION.encode())] = _DROPPED
_KIND[[ord(c) for c in WHITESPACE if ord(c) < 128]] = _SPACE
_KIND[[c[0] for c in _WIDE[2]]] = _TWO
_KIND[[c[0] for c in _WIDE[3]]] = _THREE


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts, one text after another, and how many each text has; a null text has none."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    words, counts, start = [], [], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
        found, held = _words(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        words.append(found)
        counts.append(held)
        start = end
    return pa.concat_arrays(words) if words else pa.array([], pa.large_string()), np.concatenate([np.zeros(0, np.int64), *counts])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    kind = _KIND[data]
    for n, lead in ((2, _TWO), (3, _THREE)):
        at = np.flatnonzero(kind == lead)
        if len(at):
            code = sum(data[at + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n))
            at = at[np.isin(code, [int.from_bytes(c, "big") for c in _WIDE[n]])]
            for k in range(n):
                kind[at + k] = _SPACE
    # A word goes on until white space or the next text; what is dropped does not end it.
    cuts = kind == _SPACE
    cuts[offsets[:-1][offsets[:-1] < len(data)]] = True
    stretch = np.cumsum(cuts, dtype=np.int64)
    kept = np.flatnonzero((kind != _SPACE) & (kind != _DROPPED))
    stretch = stretch[kept]
    starts = np.flatnonzero(np.diff(stretch, prepend=-1))
    ends = np.append(starts, len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[kept].tobytes()))
    text = np.searchsorted(offsets, kept[starts], "right") - 1
    return words, np.bincount(text, minlength=len(offsets) - 1)
