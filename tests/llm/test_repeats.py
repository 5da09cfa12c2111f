from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from fringeflow.llm import repeats


def brute_force(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        covered = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        spans = int((covered[1:] < covered[:-1]).sum())
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((doc_id, len(b), len(b) - len(kept), spans, kept))
    return sorted(out, key=str)


def planted(prose, rnd):
    passages = [prose(12), prose(15), "é" * 40, "ab" * 60]
    rows = [(i, f"{prose(rnd.randrange(30))}{rnd.choice(passages)}{prose(rnd.randrange(30))}") for i in range(40)]
    return rows + [(50, "z" * 150), (51, "xy" * 35), (52, passages[0][3:60] + "!" + passages[0])]


@pytest.mark.parametrize("length,variants", [(50, 1 << 14), (50, 1), (33, 3), (200, 1 << 14)])
def test_removal_matches_brute_force(make_docs, awkward, prose, length, variants):
    rows = [(i, t) for i, t in awkward if len(t or "") < 10_000] + planted(prose, random.Random(length))
    got = repeats.remove_repeats(make_docs(rows), length, variants).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute_force(rows, length)
    assert all(r.first == "x" and r["size"] == "x" for r in got)


def test_long_texts_in_segments(make_docs, prose, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    monkeypatch.setattr(repeats, "SORTED_ROWS", 8)
    shared = prose(300)
    rows = [(1, prose(400) + shared), (2, shared + prose(100)), (3, prose(200))]
    got = repeats.remove_repeats(make_docs(rows), 60).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute_force(rows, 60)


def test_text_form_keeps_whole_characters(make_docs, prose):
    rows = [(1, "é" * 30 + "a" + prose(20)), (2, "b" + "é" * 30 + prose(20)), (3, None), (4, "")]
    docs = make_docs(rows)
    got = repeats.drop_repeats(docs, 35)
    assert got.columns == docs.columns
    named = docs.selectExpr("*", "doc_id * 2 as n_bytes", "'y' as _key")
    rows_got = repeats.drop_repeats(named, 35).collect()
    assert all((r.kept, r.n_bytes, r._key, r.ref) == (7, r.doc_id * 2, "y", "x") for r in rows_got) and len(rows_got) == 4
    want = {i: kept.decode(errors="ignore") for i, *_, kept in brute_force(rows, 35)} | {3: None}
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_empty_table(make_docs):
    assert repeats.remove_repeats(make_docs([]), 50).collect() == []


def test_prefix_classes_match_direct_comparison():
    """Windows found through sorted suffixes and common prefixes equal those found by looking at their bytes."""
    rnd = random.Random(4)
    anchor, reach, count, rows = [], [], [], []
    for _ in range(200):
        k, n = rnd.randrange(6), rnd.randrange(1, 6)
        n = min(n, k + 1)
        anchor.append(rnd.randrange(3))
        reach.append(k)
        count.append(n)
        rows.append(bytes(rnd.choice(b"ab") for _ in range(n - 1 + 7)))
    found = repeats.repeated_windows(np.array(anchor), np.array(reach), np.array(count), rows, 7)
    windows = Counter((a, k - w, r[w : w + 7]) for a, k, n, r in zip(anchor, reach, count, rows) for w in range(n))
    for i, (a, k, n, r) in enumerate(zip(anchor, reach, count, rows)):
        for w in range(n):
            assert found[i, k - w] == (windows[(a, k - w, r[w : w + 7])] > 1)
