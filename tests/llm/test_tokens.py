"""Encoding, packing and token counts against the tokenizers library and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.fixtures import awkward, awkward_texts, empty
from tokenizers import Tokenizer

from quarrylens.llm import bpe, packing, token_counts

PARTS = [" ", "  ", "\n", "\t", " ", "　", " ", "a", "é", "ing", " the", "'s", "!", "9", "½", "中文", "\x1c", "\x85", "🙂", "<|endoftext|>", "qx" * 90, "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def encoder():
    return bpe.ForcedBoundaryBPE(bpe.default_vocabulary())


def test_ids_and_text_equal_the_library(encoder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts.append(" ".join(rng.choice(PARTS) for _ in range(8000)))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids
        assert encoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_fragments_join_to_the_text(encoder):
    text = " ".join(["word"] * 3000) + "  \n x"
    parts = list(encoder.fragments(text))
    assert "".join(parts) == text and len(parts) > 3


def test_cuts_lie_in_no_token(encoder):
    raw = "qxqxzz the".encode()
    for cut in encoder.cuts(raw):
        assert not encoder.joined[raw[cut - 1], raw[cut]]


def test_decoding_broken_bytes(encoder, library):
    ids = [i for i, token in enumerate(encoder.tokens.to_pylist()) if token in (b"\xc3", b"\xe4")]
    assert encoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_encode_then_decode_tables(spark):
    docs = awkward(spark)
    back = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in awkward_texts())
    assert bpe.encoding_digests(empty(spark)).count() == 0
    assert bpe.encoding_digests(docs).count() == len(awkward_texts())


def test_pieces_and_sequences(spark, encoder):
    rows = packing.pack_documents(awkward(spark), capacity=64).collect()
    by_doc: dict = {}
    for i, t in awkward_texts():
        ids = [*encoder.encode(t).tolist(), 0]
        by_doc.setdefault(i, []).append(ids)
    want = Counter()
    for i, texts in by_doc.items():
        for ids in texts:
            for start in range(0, len(ids), 64):
                part = ids[start : start + 64]
                want[i, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark)).count() == 0


def test_patterns_hold_every_piece():
    rng = random.Random(2)
    for _ in range(30):
        histogram = dict(Counter(rng.randint(1, 32) for _ in range(rng.randint(1, 300))))
        patterns = packing.packing_patterns(histogram, 32)
        held = Counter()
        for pattern, count in patterns:
            assert count > 0 and sum(k * n for k, n in pattern.items()) <= 32
            for k, n in pattern.items():
                held[k] += n * count
        assert held == Counter(histogram)
    assert packing.packing_patterns({}, 32) == []
    assert sum(n for _, n in packing.packing_patterns({1: 10**12, 1024: 7}, 1024)) <= 10**12 // 1024 + 8


def test_histogram_and_limits(spark, encoder):
    lengths = [len(encoder.encode(t)) for _, t in awkward_texts()]
    sums = token_counts.token_counts(awkward(spark)).cache()
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_longer == sum(n > r.n_tokens for n in lengths)
        assert r.tokens_longer == sum(n for n in lengths if n > r.n_tokens)
        assert (r.all_docs, r.all_tokens) == (len(lengths), sum(lengths))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert abs(r.quantile - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    ordered = sorted(lengths)
    for r in token_counts.length_quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == next(n for n in ordered if sum(m <= n for m in ordered) >= r.share * len(ordered))
    for r in token_counts.truncated_totals(sums, [0, 7, 10**6]).collect():
        assert r.truncated_total == sum(min(n, r.limit) for n in lengths)
    assert token_counts.token_counts(empty(spark)).count() == 0
