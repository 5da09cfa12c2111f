from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.llm import jaccard_join, shingles
from fringeflow.sources.stage_store import SETTLED, settle

LOWER = {i: i + 32 for i in range(65, 91)}


def text_set(text, width):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def components(rows, width, percent):
    sets = [text_set(t, width) for _, t in rows]
    place = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                place = [place[j] if p == place[i] else p for p in place]
    least = {}
    for (i, _), p, s in zip(rows, place, sets):
        ids = [x for x in (i, least.get(p)) if x is not None]
        least[p] = min(ids, default=None)
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted([(i, len(s), least[p] if s else i) for (i, _), p, s in zip(rows, place, sets)], key=order)


def near_copies(prose, rnd):
    rows = []
    for group in range(6):
        base = prose(rnd.choice([5, 25, 60, 120])).split()
        for copy in range(12):
            changed = list(base)
            for _ in range(rnd.randrange(4)):
                changed[rnd.randrange(len(changed))] = f"w{rnd.randrange(5)}"
            rows.append((1000 + 50 * group + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
def test_components_match_all_pairs(make_docs, awkward, prose, width, percent):
    rows = [(i, t) for i, t in awkward if len(t or "") < 10_000] + near_copies(prose, random.Random(width))
    got = jaccard_join.jaccard_components(make_docs(rows), width, percent).collect()
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([tuple(r) for r in got], key=order) == components(rows, width, percent)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_long_lists_lose_no_link(make_docs, prose, monkeypatch, levels):
    """Families by lists alone, some of them chained through shared passages, some with changes in common."""
    monkeypatch.setattr(jaccard_join, "SHORT", 1)
    monkeypatch.setattr(jaccard_join, "SHORT_DIFFERENCES", 2)
    monkeypatch.setattr(jaccard_join, "SAMPLE", 5)
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8 if levels == 3 else 256)
    monkeypatch.setattr(jaccard_join, "EDGES", 4 if levels == 1 else 1 << 14)
    passage, rnd = prose(40), random.Random(levels)
    rows = near_copies(prose, rnd)
    rows += [(i, f"{passage} {prose(rnd.randrange(12))}") for i in range(40)]
    rows += [(100 + i, f"{prose(8)} {t}") for i, (_, t) in enumerate(rows[:24])]
    got = jaccard_join.jaccard_components(make_docs(rows), 3, 80).collect()
    assert sorted(map(tuple, got)) == components(rows, 3, 80)


@pytest.mark.parametrize("frequent", [0, 1])
def test_frequent_shingles_change_no_answer(make_docs, prose, monkeypatch, frequent):
    """Shared passages make shingles frequent; moving them to the end of the order keeps the join exact."""
    monkeypatch.setattr(jaccard_join, "RARE", 2 if frequent else 10**9)
    passage, rnd = prose(40), random.Random(3)
    rows = near_copies(prose, rnd)
    rows += [(i, f"{passage} {prose(rnd.randrange(12))}") for i in range(40)]
    got = jaccard_join.jaccard_components(make_docs(rows), 3, 90).collect()
    assert sorted(map(tuple, got)) == components(rows, 3, 90)


def test_common_words_make_no_families(make_docs, monkeypatch):
    """Texts that share many shingles of common words by chance, and none of their rare ones, do not meet."""
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    found, families = [], jaccard_join.list_families

    def counted(*args):
        made = families(*args)
        found.append(made.count())
        return made

    monkeypatch.setattr(jaccard_join, "list_families", counted)
    rnd = random.Random(11)
    rows = []
    for i in range(150):
        text = [rnd.choice(["the", "of", "and"]) for _ in range(60)]
        for at in range(5, 60, 10):
            text[at] = f"rare{i}x{at}"
        rows.append((i, " ".join(text)))
    rows.append((150, rows[0][1] + " last"))
    got = jaccard_join.jaccard_components(make_docs(rows), 3, 90).collect()
    assert sorted(map(tuple, got)) == components(rows, 3, 90)
    assert found == [2]


def test_disk_is_freed_on_the_way(spark, make_docs, prose):
    """Only what the result reads stays stored, and no shuffle file of a settled stage does."""

    def shuffle_files():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffle_files()
    settle(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffle_files() - before):
            break
        time.sleep(0.2)
    assert not left
    rows = near_copies(prose, random.Random(2))
    since = len(SETTLED)
    kept = jaccard_join.keep_one_of_each(make_docs(rows), 3, 80)
    assert len(SETTLED) == since + 1
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in components(rows, 3, 80)})


def test_empty_table(make_docs):
    assert jaccard_join.jaccard_components(make_docs([]), 3, 90).collect() == []
    assert jaccard_join.keep_one_of_each(make_docs([]), 3, 90).collect() == []


def test_one_row_of_each_component_stays(make_docs, awkward):
    docs = make_docs(awkward)
    kept = jaccard_join.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    blank = [r for r in awkward if not (r[1] or "").split()]
    assert sorted(map(str, got)) == sorted(map(str, blank + [r for r in dict.fromkeys(awkward) if r[1] and r[1].split() and r in got]))
    base = next(t for i, t in awkward if i == 4)
    assert [r for r in got if r[1] and r[1].startswith(base[:10])] == [(4, base)]
    assert len(got) == len(blank) + len({c for _, n, c in components([r for r in awkward if len(r[1] or "") < 10_000], 5, 80) if n}) + 1


@pytest.mark.parametrize("segment", [1 << 20, 64])
def test_shingle_hashes_are_as_distinct_as_shingles(monkeypatch, awkward, segment):
    monkeypatch.setattr(shingles, "SEGMENT", segment)
    hasher = shingles.WordHasher()
    for _, text in [r for r in awkward if len(r[1] or "") < 10_000]:
        assert len(hasher.shingles(text or "", 3)) == len(text_set(text, 3))
    assert (hasher.shingles("Ab c", 3) == hasher.shingles("ab\tC", 3)).all()
    assert (hasher.words("ab c ab") == hasher.words("x ab")[[1, 1, 1]]).tolist() == [True, False, True]
    assert np.all(np.diff(hasher.shingles("a b c d e f g", 2).astype(float)) > 0)
