"""Sources as islands: connected cells above a limit, over all facets of the mosaic."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import idiv, wide
from fringeflow.operators.components import connected_components
from fringeflow.operators.dataflow import fan_out, group
from fringeflow.plans.joins import lookup
from fringeflow.sources.stage_store import settle

LABELLED = "facet int, u int, w int, cell bigint, x int, y int, label bigint"


def mosaic_side(config: ImagingConfig) -> int:
    """Facets along a side of the square they fill row by row."""
    return isqrt(config.facets - 1) + 1


def bright_cells(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Cells of ``cells(facet, polarisation, u, w, cell)``, summed over polarisations, above their facet's limit.

    That is ``peak_threshold`` and ``island_percent`` of the facet's mean.
    ``x, y`` is a cell's place in the mosaic.
    """
    sums = group(cells, ["facet", "u", "w"], "cast(sum(cell) as bigint) as cell")
    means = group(sums, ["facet"], "sum(cell) as total", "count(*) as n")
    n, side = config.cells, mosaic_side(config)
    over = f"cell > {config.peak_threshold} and cast(cell as decimal(20,0)) * n * 100 > cast(total as decimal(20,0)) * {config.island_percent}"
    return lookup(sums, means, ["facet"], bounded=True).where(over).selectExpr(
        "facet", "u", "w", "cell", f"cast({idiv('facet', side)} * {n} + u as int) as x", f"cast(facet % {side} * {n} + w as int) as y"
    )


def label_facets(bright: DataFrame, config: ImagingConfig) -> DataFrame:
    """``label`` of each bright cell: the number of the first cell it is connected with inside its facet.

    Cells touch at edges and corners. A facet is one group of at most
    ``cells**2`` rows.
    """
    width = mosaic_side(config) * config.cells

    def run(facet: pa.Table) -> pa.Table:
        x, y = (facet[c].to_numpy().astype(np.int64) for c in ("x", "y"))
        numbers = x * width + y
        labels = pa.array([root for root in _roots(numbers.tolist(), width)], pa.int64())
        return facet.append_column("label", labels)

    return bright.groupBy("facet").applyInArrow(run, LABELLED)


def _roots(numbers: list[int], width: int) -> Iterator[int]:
    """For each cell number, the smallest one that it is connected with, by union-find."""
    parent = {c: c for c in numbers}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for c in numbers:
        column = c % width
        for step in (1, width - 1, width, width + 1):
            other = c + step
            # The last column's right neighbour is not the next row's first cell.
            if other in parent and abs(other % width - column) <= 1:
                a, b = find(c), find(other)
                parent[max(a, b)] = min(a, b)
    return map(find, numbers)


def join_facets(labelled: DataFrame, config: ImagingConfig) -> DataFrame:
    """Labelled cells with ``island``: labels that touch across facet edges become one."""
    n, last = config.cells, config.cells - 1
    border = labelled.where(f"u in (0, {last}) or w in (0, {last})")
    around = fan_out(border.select("facet", "x", "y", "label"), {"dx": 3, "dy": 3})
    around = around.selectExpr("facet as of_facet", "label as a", "cast(x + dx - 1 as int) as x", "cast(y + dy - 1 as int) as y")
    # Both sides are border cells, of which the configuration allows 4 * cells a facet.
    touching = lookup(around, border.selectExpr("facet", "x", "y", "label as b"), ["x", "y"], bounded=True, how="inner")
    joined = connected_components(touching.where("facet <> of_facet and a <> b").select("a", "b").distinct())
    islands = lookup(labelled, joined.selectExpr("node as label", "component"), ["label"], bounded=True)
    return islands.selectExpr("facet", "u", "w", "cell", "x", "y", "coalesce(component, label) as island")


def source_islands(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """One row per island: brightest cell, flux, size, centre in thousandths of a cell, and extent in the mosaic."""
    # Read three times below: as borders on both sides, and whole.
    inside = settle(label_facets(bright_cells(cells, config), config), "labelled")
    labelled = join_facets(inside, config)
    first = "min(named_struct('order', -cell, 'x', x, 'y', y, 'facet', facet, 'u', u, 'w', w)) as first"
    centre = "cast(sum({0} * {1} * 1000) div cast(sum(cell) as decimal(20,0)) as bigint) as {1}_milli".format
    extent = [f"{least}({axis}) as {axis}_{name}" for axis in "xy" for least, name in (("min", "first"), ("max", "last"))]
    sums = group(labelled, ["island"], first, "sum(cell) as flux", "count(*) as n_cells", centre(wide("cell"), "x"), centre(wide("cell"), "y"), *extent)
    places = [f"first.{c} as {c}" for c in ("facet", "u", "w")]
    measures = ["flux", "n_cells", "x_milli", "y_milli", "x_first", "x_last", "y_first", "y_last"]
    return sums.selectExpr("island", *places, "-first.order as peak", *measures)
