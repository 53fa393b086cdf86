"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged, so a
text may be cut there and the fragments encoded one by one.  Two kinds of such
cuts are used:

* between a character that is not white space and a blank, for which no
  context of the pre-tokenizer matters either: texts of any length fall apart
  into fragments of bounded size;
* inside one long pre-token, between any two bytes that no token holds side
  by side: a run without blanks falls apart further.

Null texts are empty, an empty text has no ids and decodes to an empty text.
Added tokens of the vocabulary file are found in the text first, as the
library does.  A text is one row and is encoded inside its task; no shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pre-tokenizer pattern of byte-level BPE files with use_regex.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters after which the next certain cut ends a fragment.
FRAGMENT = 2_000
# A pre-token of more bytes is searched for byte pairs that force a cut.
LONG_PIECE = 128


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary of 50k tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file.

    Printable Latin-1 bytes stand for themselves, the others are numbered from
    U+0100 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    letters.update({chr(256 + k): b for k, b in enumerate(hidden)})
    return letters


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        letters = byte_letters()
        added = {item["content"]: item["id"] for item in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        numbers = [spec["model"]["vocab"][m] for m in merged]
        if numbers != sorted(numbers):
            raise ValueError(f"{path}: token ids do not follow the order of merges")
        plain = [item for item in spec["added_tokens"] if item["lstrip"] or item["rstrip"] or item["single_word"]]
        if plain or spec["normalizer"] is not None:
            raise ValueError(f"{path}: only byte-level files without normalizer are read")
        self.added = added
        self._split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._library = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self._pieces = regex.compile(PIECES)
        self._unbroken = re.compile(r"\S{%d}" % LONG_PIECE)
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            raw = np.frombuffer(token, np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        # Last bytes after which a blank always starts a new fragment.
        self._loose_end = frozenset(int(b) for b in range(256) if not self.joined[b, 32])
        table: list[bytes] = [b""] * (max([*ranks.values(), *added.values()], default=-1) + 1)
        for token, n in ranks.items():
            table[n] = token
        for token, n in added.items():
            table[n] = token.encode()
        self.tokens = pa.array(table, pa.large_binary())
        self.end_id = max(added.values(), default=None)

    def cuts(self, raw: bytes) -> list[int]:
        """Positions inside ``raw`` where no token can cross."""
        codes = np.frombuffer(raw, np.uint8)
        return (np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1).tolist()

    def fragments(self, text: str) -> Iterator[str]:
        """The text in fragments of about ``FRAGMENT`` characters, each between certain cuts."""
        start, seek = 0, FRAGMENT
        while seek < len(text):
            blank = text.find(" ", seek)
            if blank < 0:
                break
            before = text[blank - 1]
            if before.isspace() or before.encode()[-1] not in self._loose_end:
                seek = blank + 1
                continue
            yield text[start:blank]
            start, seek = blank, blank + FRAGMENT
        yield text[start:]

    def _fragment(self, text: str) -> list[int]:
        """Ids of one fragment."""
        if not self._unbroken.search(text):
            return self._library.encode_ordinary(text)
        out: list[int] = []
        for piece in self._pieces.findall(text):
            raw = piece.encode()
            cuts = self.cuts(raw) if len(raw) > LONG_PIECE else []
            for a, b in zip([0, *cuts], [*cuts, len(raw)]):
                out.extend(self._library._encode_single_piece(raw[a:b]))
        return out

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        return b"".join(array("I", self._fragment(part)).tobytes() for part in self.fragments(text))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._split_added is None or not any(token in text for token in self.added):
            return self._plain(text)
        parts = self._split_added.split(text)
        return b"".join(
            array("I", [self.added[part]]).tobytes() if k % 2 else self._plain(part) for k, part in enumerate(parts) if part
        )

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens behind one another."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        data = taken.buffers()[2]
        return b"" if data is None else data.to_pybytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def load_bpe(path: str) -> ForcedBoundaryBPE:
    """One encoder per Python worker and file."""
    return ForcedBoundaryBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, ids array<long>) of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t).astype(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = docs.select(id_column).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """(id, text) of every row of ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.select(id_column).schema[0].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_column).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def encoding_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Encodes and decodes in one pass and returns digests only, so that neither
    ids nor texts leave the task.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for cell in batch.column(1):
                raw = bpe.encode_bytes(cell.as_py())
                counts.append(len(raw) // 4)
                coded.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, for comparisons in tests."""
    with open(path, "rb") as handle:
        return {base64.b64decode(token): int(n) for token, n in map(bytes.split, handle)}
