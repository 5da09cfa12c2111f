from __future__ import annotations

import random

import pytest

EXTRA = "n long, at int, hash long, size string, first string, score string, kept int, ref string, split string, lang string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns named like inner ones of the operators."""

    def make(rows, parts=3):
        full = [(i, t, 7, 7, 7, "x", "x", "x", 7, "x", "x", "aa") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


@pytest.fixture
def prose(words):
    rnd = random.Random(9)
    return lambda n: " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture
def awkward(prose):
    """Null ids and texts, empty and blank texts, repeated rows, ties, and one very long text."""
    base = prose(60)
    rows = [(None, None), (None, ""), (None, base), (1, None), (2, ""), (3, " \n\t"), (4, base), (4, base), (5, base)]
    rows += [(6, base.replace(" ", "\t", 1)), (7, base + " zz"), (7, prose(40)), (8, prose(30_000)), (9, "a"), (10, "ß é 日本 !")]
    return rows + [(100 + i, prose(80)) for i in range(20)]
