from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from fringeflow.llm import line_labels
from fringeflow.llm.line_labels import FEATURES, Field
from fringeflow.llm.queries import op13_line_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_field(seed=1):
    rnd = np.random.default_rng(seed)
    return Field(rnd.normal(size=len(FEATURES)), rnd.normal(size=(2, 2)), rnd.normal(size=2))


def score(field, features, labels):
    path = field.first[labels[0]] + sum(field.follows[a, b] for a, b in zip(labels, labels[1:]))
    return path + sum(features[i] @ field.weights for i, y in enumerate(labels) if y == line_labels.CONTENT)


def counts(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def check(rows, got, field):
    key = lambda r: tuple((x is not None, x) for x in r)
    want = []
    for doc_id, text in rows:
        *base, failed = counts(text)
        labels = line_labels.viterbi(field, line_labels.read_text(text).features)
        content = sum(len(WORD.findall(line)) for line, y in zip((text or "").split("\n"), labels) if y)
        want.append((doc_id, *base, content, failed, not failed and 2 * content >= base[0]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return want


def test_statistics_and_verdicts_equal_brute_force(make_docs, awkward, prose):
    rnd = random.Random(1)
    rows = list(awkward) + [(500, "a a a a b c a a a\n\n a\x0bb\n a\x0bb\n\x1c\x85\xa0 ### <p>"), (501, "\n".join(["x y z"] * 40))]
    for i in range(200):
        lines = [rnd.choice([prose(9), prose(9).upper(), "## " * 5, "", "www.a.b 12", "same line", "é日本 % "]) for _ in range(rnd.randrange(30))]
        rows.append((600 + i, rnd.choice(["\n", "\r\n", "\n\n"]).join(lines)))
    weights = {"bias": 0.3, "upper": -4, "symbols": -4, "digits": -4, "ends_sentence": 1}
    field = Field(np.array([weights.get(name, 0) for name in FEATURES]), np.array([[1, -1], [-1, 1]]) / 4, np.zeros(2))
    want = check(rows, line_labels.judge_lines(make_docs(rows), field).collect(), field)
    assert {True, False} == {r[-1] for r in want if not r[-2]}
    assert line_labels.judge_lines(make_docs([]), field).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_finds_the_best_of_all_paths(seed):
    field = some_field(seed)
    features = np.random.default_rng(seed + 50).normal(size=(seed + 1, len(FEATURES)))
    paths = list(itertools.product((0, 1), repeat=len(features)))
    best = max(paths, key=lambda y: score(field, features, y))
    assert tuple(line_labels.viterbi(field, features)) == best


def test_likelihood_and_gradient_equal_sums_over_all_paths():
    field, rnd = some_field(3), np.random.default_rng(4)
    lengths = np.array([1, 3, 5])
    features = rnd.normal(size=(3, 5, len(FEATURES)))
    labels = rnd.integers(0, 2, size=(3, 5))

    def direct(f):
        total = 0
        for x, y, n in zip(features, labels, lengths):
            scores = [score(f, x[:n], p) for p in itertools.product((0, 1), repeat=n)]
            total += score(f, x[:n], y[:n]) - np.logaddexp.reduce(scores)
        return total / lengths.sum()

    value, gradient = line_labels.likelihood(field, features, labels, lengths)
    assert value == pytest.approx(direct(field))
    for name in ("weights", "follows", "first"):
        for at in np.ndindex(getattr(field, name).shape):
            ends = []
            for step in (1e-5, -1e-5):
                moved = {k: getattr(field, k).copy() for k in ("weights", "follows", "first")}
                moved[name][at] += step
                ends.append(direct(Field(**moved)))
            assert getattr(gradient, name)[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_query_keeps_good_documents_and_drops_bad_ones(spark, data_dir):
    got = {r.doc_id: r for r in op13_line_labels(spark, data_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    judged = [(quality[i], r.kept) for i, r in got.items() if i in quality and not r.base_failed]
    for value in (0, 1):
        assert np.mean([kept == value for q, kept in judged if q == value]) > 0.95


def test_labels_that_are_missing_null_or_repeated(spark, make_docs, awkward, prose):
    docs = make_docs([*awkward, (300, prose(70))])
    schema = "doc_id long, quality int, text string"
    field = line_labels.learn_lines(docs, spark.createDataFrame([], schema))
    assert not field.weights.any() and not field.follows.any()
    assert all(r.kept != r.base_failed for r in line_labels.judge_lines(docs, field).collect())
    labels = [(None, 1, "a"), (4, None, "a"), (300, 0, "a"), (300, 1, "b"), (4, 1, "a"), (6, 0, "x")]
    field = line_labels.learn_lines(docs, spark.createDataFrame(labels, schema))
    assert np.isfinite(field.weights).all() and field.weights.any()
