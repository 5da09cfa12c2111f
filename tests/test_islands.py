"""Islands and connected components against plain flood fill."""

from __future__ import annotations

import random

import pytest

from fringeflow import ImagingConfig
from fringeflow.operators import islands
from fringeflow.operators.components import connected_components

CELLS = "facet int, polarisation int, u int, w int, cell bigint"


def flood(lit: dict) -> list[set]:
    """Sets of places in ``lit`` that touch at edges or corners."""
    left, found = set(lit), []
    while left:
        todo, here = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            here.add((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        found.append(here)
    return found


def check(spark, config: ImagingConfig, values: dict) -> int:
    """``values`` by (x, y) of the mosaic, spread over two polarisations."""
    n, side = config.cells, islands.mosaic_side(config)
    rows = [((x // n) * side + y // n, p, x % n, y % n, v // 2 + p * (v % 2)) for (x, y), v in values.items() for p in (0, 1)]
    facets: dict = {}
    for (x, y), v in values.items():
        facets.setdefault((x // n, y // n), []).append(v)
    lit = {
        (x, y): v
        for (x, y), v in values.items()
        if v > config.peak_threshold and v * len(f := facets[x // n, y // n]) * 100 > config.island_percent * sum(f)
    }
    want = []
    for places in flood(lit):
        flux = sum(lit[p] for p in places)
        top = min(places, key=lambda p: (-lit[p], p))
        xs, ys = [p[0] for p in places], [p[1] for p in places]
        centre = [sum(lit[p] * p[i] * 1000 for p in places) // flux for i in (0, 1)]
        name = min(x * side * n + y for x, y in places)
        want.append(
            (name, (top[0] // n) * side + top[1] // n, top[0] % n, top[1] % n, lit[top], flux, len(places), *centre, min(xs), max(xs), min(ys), max(ys))
        )
    got = islands.source_islands(spark.createDataFrame(rows, CELLS), config).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    return len(want)


@pytest.mark.parametrize("seed,share", [(1, 0.1), (2, 0.35), (3, 0.6)])
def test_islands_equal_flood_fill(spark, seed, share):
    rnd = random.Random(seed)
    config = ImagingConfig(facets=9, cells=6, island_percent=100)
    values = {(x, y): rnd.randint(2000, 9000) if rnd.random() < share else rnd.randint(0, 900) for x in range(18) for y in range(18)}
    assert check(spark, config, values)


def test_one_snake_through_all_facets(spark):
    config = ImagingConfig(facets=9, cells=4, island_percent=100, peak_threshold=10)
    path = {(x, y) for x in range(0, 12, 2) for y in range(12)} | {(x, 11 if x % 4 == 1 else 0) for x in range(1, 11, 2)}
    assert check(spark, config, {(x, y): 5000 + x if (x, y) in path else 1 for x in range(12) for y in range(12)}) == 1


def test_corners_touch_and_the_mosaic_does_not_wrap(spark):
    config = ImagingConfig(facets=4, cells=4, island_percent=100, peak_threshold=10)
    lit = {(3, 3), (4, 4), (0, 7), (7, 0), (0, 0)}
    assert check(spark, config, {(x, y): 900 if (x, y) in lit else 1 for x in range(8) for y in range(8)}) == 4


def test_no_bright_cells(spark):
    assert check(spark, ImagingConfig(facets=4, cells=4), {(x, y): 5 for x in range(8) for y in range(8)}) == 0
    assert islands.source_islands(spark.createDataFrame([], CELLS), ImagingConfig()).collect() == []


def test_components_equal_flood_fill_of_edges(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5), (None, 3)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
