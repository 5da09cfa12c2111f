from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from fringeflow.llm import spelling

UPPER = str.maketrans(spelling.UPPER, spelling.LOWER)


def brute_force(rows, min_chars=7, min_count=2, ratio=10, delete_one_in=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % delete_one_in == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= min_chars:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect())


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    stems = ["banana", "colour", "Éclairs", "aaaaaaa", "übergrößen", "organise"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(30):
            w = rnd.choice(stems) + rnd.choice(["", "a", "s", "ing", "ment"])
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = w[:at] + rnd.choice(["", "x", w[at] * 2, "é"]) + w[at + 1 :]
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, rnd.choice([" ", ", ", "9"]).join(words)))
    return rows


@pytest.mark.parametrize("most", [spelling.BLOCK_WORDS, 3])
def test_groups_equal_brute_force(make_docs, texts, most):
    rows = [*texts, *texts[:5]]
    got = rows_of(spelling.variant_groups(make_docs(rows), 7, 2, 10, 31, most))
    want = brute_force(rows)
    assert got == want
    assert any(r[1] for r in want) and sum(r[4] for r in want) > 100


def test_chains_of_forms_reach_their_root(make_docs):
    words = {"abcdefghij": 700, "abcdefghi": 60, "abcdefgh": 5, "abcdefg": 1, "zzzzzzzz": 4, "zzzzzzzy": 4}
    rows = [(i, " ".join(w for w, n in words.items() if i < n)) for i in range(700)]
    got = rows_of(spelling.variant_groups(make_docs(rows), 7, 1, 5, 10**9))
    assert got == brute_force(rows, 7, 1, 5, 10**9)
    assert {r[0]: r[2] for r in got}["abcdefg"] == "abcdefghij"


def test_awkward_rows(make_docs, awkward):
    rows = [*awkward, (None, "repeated repeated repeatde"), (11, "x" * 5000 + " " + "x" * 5000), (12, "×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    got = rows_of(spelling.variant_groups(make_docs(rows), 7, 2, 10, 31))
    assert got == brute_force(rows)
    assert spelling.variant_groups(make_docs([]), 7, 2, 10, 31).collect() == []


def test_no_block_is_larger_than_asked(make_docs, spark):
    words = spark.range(3000).selectExpr("concat('prefixes', conv(id, 10, 26)) as word", "1L as n")
    words = words.selectExpr("translate(word, '0123456789', 'ABCDEFGHIJ') as word", "n")
    sizes = spelling.bounded_blocks(words, 50).groupBy("block", "s", "e").count()
    assert sizes.where("count > 50 and e - s > 1").isEmpty()
