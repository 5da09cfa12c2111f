from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from fringeflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> x", "It's 12é!! \u2028 İstanbul ΑΣ", "e\u0301 \x1c ok", "x" * 5000, "A\u00a0B", "日本語 🎉"]


def test_pieces_fill_sequences_without_gaps(make_docs, awkward):
    rows = awkward + list(enumerate(ODD, 500)) + [(600, "copy of a row")] * 50
    got = packing.pack_documents(make_docs(rows, 5), PATH, 256).collect()
    library = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            expected[(i, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) <= 1.02 * sum(r.length for r in got) / 256 + 2


def test_empty_table(make_docs):
    assert packing.pack_documents(make_docs([]), PATH, 256).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(129, dtype=np.int64)
    for length in rng.integers(1, 129, rng.integers(1, 60)):
        histogram[length] += rng.integers(1, 10 ** rng.integers(1, 7))
    plan = packing.pack_histogram(histogram)
    used = np.zeros(129, dtype=np.int64)
    for lengths, count in plan.patterns:
        assert sum(lengths) <= 128 and count > 0
        for length in lengths:
            used[length] += count
    assert (used == histogram).all()


def test_least_squares_against_exact_mix():
    """Where patterns of few documents fill sequences exactly, all are filled."""
    histogram = np.zeros(101, dtype=np.int64)
    histogram[[60, 40, 50, 25]] = 3000, 3000, 1000, 2000
    patterns = packing.few_document_patterns(histogram)
    counts = packing.fit_counts(patterns, histogram.astype(float))
    rebuilt = np.bincount(patterns.ravel(), np.repeat(counts, 3), 101)
    assert np.abs(rebuilt - histogram)[1:].max() < 10
    assert sum(c for _, c in packing.pack_histogram(histogram).patterns) == (histogram * np.arange(101)).sum() / 100
