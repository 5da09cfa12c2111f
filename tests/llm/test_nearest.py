from __future__ import annotations

import numpy as np

from fringeflow.llm import nearest


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, shard string, rank int").repartition(3)


def test_recall_against_all_products(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((3000, 32)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    got = nearest.nearest_neighbours(frame(spark, [(i, p.tolist()) for i, p in enumerate(points)]), "vec_id % 20 = 0", 10).collect()
    wide = points.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        products = wide @ wide[q]
        products[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -products))[:10].tolist())
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - products[r.vec_id]) < 1e-9 for r in mine)
        hits += len(best & {r.vec_id for r in mine})
    assert hits / 1500 > 0.9


def test_copies_come_in_order_of_their_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(500, [9.0, 9.0])]
    got = nearest.nearest_neighbours(frame(spark, rows), "vec_id in (0, 100)", 5).collect()
    ranked = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert ranked == {0: [500, 1, 2, 3, 4], 100: [500, 0, 1, 2, 3]}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0]]
    rows = [(20 * i, v) for i, v in enumerate(odd, 1)] + [(None, [1.0, 1.0]), (0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [2.0, 1.0])]
    got = nearest.nearest_neighbours(frame(spark, rows), "vec_id % 20 = 0", 3).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 2.0)]
    assert nearest.nearest_neighbours(frame(spark, []), "true", 3).collect() == []


def test_forest_takes_all_strings_of_a_prefix():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((300, 8))
    forest = nearest.HashForest(points, float(np.linalg.norm(points, axis=1).max()))
    marked = forest.candidates(points[:10], 21)
    assert marked[np.arange(10), np.arange(10)].all()
    assert (marked.sum(axis=1) >= np.ceil(nearest.ENOUGH * 300)).all()
