from __future__ import annotations

import random

import pytest

from fringeflow.llm.components import connected_components


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def graphs():
    rnd = random.Random(1)
    return {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(100)] + [(i, 500) for i in range(50)],
        "random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(5, 5)] * 3,
        "bipartite": [(i, 1000 + j) for i in range(12) for j in range(12)],
    }


@pytest.mark.parametrize("name", list(graphs()))
def test_components_match_union_find(spark, name):
    edges = graphs()[name]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in connected_components(frame).collect()} == roots(edges)


def test_nulls_loops_and_no_edges(spark):
    frame = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "src long, dst long")
    assert connected_components(frame).collect() == []
