from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from fringeflow.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, max_words, min_count, percent, first):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            for k in range(1, max_words + 1):
                counts["und" if lang is None else lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = (
                any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= percent * a
                for q, b in candidates.items() if len(q) > len(p)
            )
            if not any(inside):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def make(spark, rows, parts):
    full = [(t, lang, 1, "x", 2) for t, lang in rows]
    return spark.createDataFrame(full, "text string, lang string, a int, phrase string, n int").repartition(parts)


def got(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def rows(words):
    rnd = random.Random(4)
    some = words[:60]
    rows = []
    for i in range(250):
        ws = rnd.choices(some, [1 / (j + 1) for j in range(60)], k=60)
        for _ in range(4):
            at = rnd.randrange(60)
            ws[at:at] = rnd.choice([["New", "York", "City"], ["over", "and", "over", "and"], ["so", "so", "so", "so"], ["Ünder", "日本"]])
        rows.append(("".join(w + rnd.choice([" "] * 12 + [", ", ".\n", "\t", "\r\n", " \t "]) for w in ws), rnd.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", "fr"), ("...", "es"), ("a b", "und"), ("a\xa0b c\x00d", None)] * 12


@pytest.mark.parametrize("parts,shards", [(1, 4), (7, 4), (20, 3)])
def test_phrases_equal_brute_force(spark, rows, parts, shards):
    wanted = brute_force(rows, 3, 10, 50, 60)
    assert len(wanted) > 100
    assert got(phrases.collocations(make(spark, rows, parts), 3, 10, 50, 60, shards)) == wanted


def test_longer_phrases(spark, rows):
    assert got(phrases.collocations(make(spark, rows, 5), 5, 6, 80, 1000)) == brute_force(rows, 5, 6, 80, 1000)


def test_small_holds_pass_counts_on_in_parts(spark, rows, monkeypatch):
    for name, value in (("HELD_CHARS", 500), ("HELD_HASHES", 300), ("HELD_PHRASES", 50), ("RANK_PARTS", 3)):
        monkeypatch.setattr(phrases, name, value)
    assert got(phrases.collocations(make(spark, rows, 5), 3, 10, 50, 60)) == brute_force(rows, 3, 10, 50, 60)


def test_no_rows_and_no_words(spark):
    for rows in ([], [(None, None), ("", "en"), (" . ", "en")]):
        assert got(phrases.collocations(make(spark, rows, 2), 3, 10, 50, 60)) == []


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits."""
    a, left, right = 3 * 10**12, 5 * 10**12 + 1, 7 * 10**12 + 3
    counts = [("en", "a b", 2, a), ("en", "a", 1, left), ("en", "b", 1, right)]
    row = phrases.scored(spark.createDataFrame(counts, "lang string, phrase string, size int, a long")).first()
    assert (row.l, row.r, row.score) == (left, right, 10**6 * a * a // (left * right))
