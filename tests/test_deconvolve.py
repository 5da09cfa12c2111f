"""Minor cycles against plain Python."""

from __future__ import annotations

import random

import pytest

from fringeflow import ImagingConfig, ImagingCycle
from fringeflow.operators import deconvolve

IMAGE = "facet int, polarisation int, k int, l int, re bigint"


def rounded(value: int, divisor: int) -> int:
    return (-1 if value < 0 else 1) * ((2 * abs(value) + divisor) // (2 * divisor))


def plain(image: dict, spread: dict, c: ImagingConfig) -> tuple[dict, list]:
    """One facet: values by (polarisation, k, l)."""
    image, found, n = dict(image), [], c.cells
    first = max(abs(v) for v in image.values())
    limit = max(c.peak_threshold, first * c.minor_stop_percent // 100)
    for step in range(1, c.minor_iterations + 1):
        place = min(image, key=lambda at: (-abs(image[at]), at))
        peak = image[place]
        flux = abs(peak) * c.minor_gain_percent // 100 * (-1 if peak < 0 else 1)
        p, u, w = place
        centre = spread.get((p, 0, 0), 0)
        if abs(peak) <= limit or not flux or not centre:
            break
        for q, a, b in image:
            if q == p:
                share = rounded(spread.get((p, (a - u) % n, (b - w) % n), 0) * 10**6, centre)
                image[q, a, b] -= rounded(flux * share, 10**6)
        found.append((*place, step, flux))
    return image, found


@pytest.mark.parametrize("most,iterations", [(5000, 60), (10**15, 25)])
def test_minor_cycles_equal_plain_python(spark, most, iterations):
    rnd = random.Random(most)
    config = ImagingConfig(facets=4, polarisations=2, cells=4, minor_stop_percent=20, minor_iterations=iterations)
    cells = [(p, k, l) for p in range(2) for k in range(4) for l in range(4)]
    images = {f: {at: rnd.randint(-most, most) for at in cells} for f in range(4)}
    spreads = {f: {at: rnd.randint(-900, 900) for at in cells} | {(p, 0, 0): 1000 + p for p in range(2)} for f in range(4)}
    images[1] = {at: v for at, v in images[1].items() if at[0]}  # one polarisation only
    spreads[2] = {at: 0 for at in cells}  # nothing measured
    images[3] = {at: 700 for at in cells}  # equal peaks, below the threshold
    frame = lambda all_: spark.createDataFrame([(f, *at, v) for f, x in all_.items() for at, v in x.items()], IMAGE)
    steps = deconvolve.minor_cycle(frame(images), frame(spreads), config)
    left = {f: {} for f in images}
    for r in deconvolve.residual_image(steps).collect():
        left[r.facet][r.polarisation, r.u, r.w] = r.residual
    found = {f: [] for f in images}
    for r in deconvolve.clean_components(steps).orderBy("facet", "step").collect():
        found[r.facet].append((r.polarisation, r.u, r.w, r.step, r.flux))
    for f, image in images.items():
        assert (left[f], found[f]) == plain(image, spreads[f], config)
    assert found[0] and found[1] and not found[2] and not found[3]
    model = {(r.facet, r.polarisation, r.u, r.w): r.flux for r in deconvolve.model_image(steps).collect()}
    assert sum(model.values()) == sum(c[-1] for x in found.values() for c in x)


def test_a_point_source_is_found_and_taken_out(spark):
    """An image that is one source seen through the point-spread image becomes that source."""
    config = ImagingConfig(facets=1, polarisations=1, cells=8, minor_stop_percent=1, peak_threshold=10)
    weights = [(0, 0, u, w, 1 + (u * w) % 3, 0) for u in range(8) for w in range(0, 8, 2)]
    cells = spark.createDataFrame(weights, "facet int, polarisation int, u int, w int, n_in bigint, n_flagged bigint")
    spread = deconvolve.point_spread(cells, config).collect()
    by_place = {(r.k, r.l): r.re for r in spread}
    assert by_place[0, 0] == sum(r[4] for r in weights)
    seen = [(0, 0, k, l, by_place[(k - 3) % 8, (l - 5) % 8] * 1000) for k in range(8) for l in range(8)]
    steps = deconvolve.minor_cycle(spark.createDataFrame(seen, IMAGE), spark.createDataFrame(spread), config)
    model = {(r.u, r.w): r.flux for r in deconvolve.model_image(steps).collect()}
    strength = by_place[0, 0] * 1000
    # A row of empty columns between the measured ones repeats the source at half the image.
    assert set(model) <= {(3, 5), (3, 1)} and sum(model.values()) >= 0.98 * strength
    assert max(abs(r.residual) for r in deconvolve.residual_image(steps).collect()) <= 0.02 * strength


def test_empty_images(spark):
    none = spark.createDataFrame([], IMAGE)
    assert deconvolve.minor_cycle(none, none, ImagingConfig()).collect() == []
    spread = spark.createDataFrame([(0, 0, 0, 0, 5)], IMAGE)
    assert deconvolve.minor_cycle(none, spread, ImagingConfig()).collect() == []
    steps = deconvolve.minor_cycle(spread, none, ImagingConfig(cells=4)).collect()
    assert len(steps) == 16 and {r.step for r in steps} == {0}


def test_facets_are_independent_groups(spark, data_dir):
    cycle = ImagingCycle(spark, data_dir, store_cells=True)
    steps = deconvolve.minor_cycle(cycle.transformed, cycle.spread, cycle.config)
    text = steps._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow [facet" in text and "SinglePartition" not in text
    cells = cycle.config.polarisations * cycle.config.cells**2
    assert steps.where("step = 0").groupBy("facet").count().where(f"count > {cells}").isEmpty()
