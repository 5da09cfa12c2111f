"""Transforms of whole images against exact sums in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fringeflow import ImagingConfig
from fringeflow.operators import fourier, kernels

CELLS = "facet int, polarisation int, u int, w int, re bigint, im bigint"


def rounded(value: int, divisor: int) -> int:
    sign = -1 if value < 0 else 1
    return sign * ((abs(value) + divisor // 2) // divisor)


def forward(cells: dict, n: int) -> dict:
    cos = [round(math.cos(2 * math.pi * j / n) * 10**6) for j in range(n)]
    sin = [round(math.sin(2 * math.pi * j / n) * 10**6) for j in range(n)]

    def one(rows: dict, divisor: int) -> dict:
        out = {}
        for k in range(n):
            for w in {w for _, w in rows}:
                here = [(x, v) for (x, w2), v in rows.items() if w2 == w]
                re = sum(a * cos[k * x % n] + b * sin[k * x % n] for x, (a, b) in here)
                im = sum(b * cos[k * x % n] - a * sin[k * x % n] for x, (a, b) in here)
                out[k, w] = rounded(re, divisor), rounded(im, divisor)
        return out

    first = one(cells, 1000)
    second = one({(w, k): v for (k, w), v in first.items()}, 10**9)
    return {(k, l): v for (l, k), v in second.items()}


@pytest.mark.parametrize("n,most", [(4, 10**15), (16, 10**15), (6, 3)])
def test_transform_equals_exact_sums(spark, n, most):
    rnd = random.Random(n)
    images = {
        (f, p): {(rnd.randrange(n), rnd.randrange(n)): (rnd.randint(-most, most), rnd.randint(-most, most)) for _ in range(n + f)}
        for f in range(3) for p in range(2)
    }
    rows = [(f, p, u, w, *v) for (f, p), cells in images.items() for (u, w), v in cells.items()]
    got = kernels.dft(spark.createDataFrame(rows, CELLS), ImagingConfig(facets=3, polarisations=2, cells=n)).collect()
    want = {(f, p, *at): v for (f, p), cells in images.items() for at, v in forward(cells, n).items()}
    assert {(r.facet, r.polarisation, r.k, r.l): (r.re, r.im) for r in got} == want and len(got) == len(want)


def test_images_of_256_cells_come_back(spark):
    config = ImagingConfig(facets=1, polarisations=1, cells=256)
    cells = spark.range(65536).selectExpr(
        "0 as facet", "0 as polarisation", "cast(id % 256 as int) as u", "cast(id div 256 as int) as w",
        "(id * 7919) % 1000003 - 500000 as re", "(id * 104729) % 999983 - 500000 as im",
    )
    back = kernels.idft(kernels.dft(cells, config), config).withColumnsRenamed({"re": "new_re", "im": "new_im"})
    off = back.join(cells, ["facet", "polarisation", "u", "w"]).selectExpr(
        "count(*) as n", "max(greatest(abs(new_re - re), abs(new_im - im))) as off"
    )
    row = off.first()
    assert row["n"] == 65536 and row["off"] <= 2 + 10**6 * 1e-5


def test_quotients_round_halves_away_from_zero():
    rnd = random.Random(1)
    values = [0, 5, -5, 15, -15, 25, 4, -4, 6, -6, *(rnd.randint(-(10**17), 10**17) for _ in range(200))]
    for divisor in (10, 1000, 7, 2_560_000_000):
        whole = np.array([v for v in values], dtype=np.int64)[:, None]
        parts = fourier.exact_products((np.array([[1.0]]), whole.T))
        got = fourier.rounded_quotient(parts, divisor)[0].tolist()
        assert got == [(-1 if v < 0 else 1) * ((2 * abs(v) + divisor) // (2 * divisor)) for v in values]


def test_sums_beyond_64_bits_raise():
    factor, value = np.full((1, 400), 1e6), np.full((400, 1), 2**62, dtype=np.int64)
    with pytest.raises(OverflowError):
        fourier.rounded_quotient(fourier.exact_products((factor, value)), 1000)


def test_larger_images_are_refused(spark):
    with pytest.raises(ValueError):
        kernels.dft(spark.createDataFrame([], CELLS), ImagingConfig(cells=1024))
