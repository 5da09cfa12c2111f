"""Gains per antenna: made-up ones are found again."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from fringeflow import ImagingConfig
from fringeflow.operators import antennas

VIS = "event_id bigint, frequency int, time int, facet int, polarisation int, baseline bigint, re bigint, im bigint"
MODEL = "frequency int, model_re bigint, model_im bigint"
CONFIG = ImagingConfig(antennas=6, channels=5, coarse_channels=5)
PAIRS = list(combinations(range(6), 2))


def made_up(seed=1, noise=0.0, without=()):
    rnd = np.random.default_rng(seed)
    gains = {t: rnd.uniform(0.5, 2, 6) * np.exp(1j * rnd.uniform(-3, 3, 6)) for t in (0, 1, 7)}
    model = {f: complex(*rnd.integers(50_000, 200_000, 2)) for f in range(5)}
    rows = []
    for t, g in gains.items():
        for i, (p, q) in enumerate(PAIRS):
            if p in without or q in without:
                continue
            for f, m in model.items():
                v = g[p] * np.conj(g[q]) * m + noise * complex(*rnd.normal(size=2))
                rows.append((len(rows), f, t, 0, 0, i + 15 * int(rnd.integers(0, 4)), round(v.real), round(v.imag)))
    return gains, model, rows


def frames(spark, rows, model):
    return spark.createDataFrame(rows, VIS), spark.createDataFrame([(f, int(m.real), int(m.imag)) for f, m in model.items()], MODEL)


def test_made_up_gains_are_found_again(spark):
    gains, model, rows = made_up()
    odd = [(-1, None, 0, 0, 0, 3, 5, 5), (-2, 1, None, 0, 0, 3, 5, 5), (-3, 1, 0, 0, 0, None, 5, 5), (-4, 1, 0, 0, 0, 3, 5, None)]
    vis, predicted = frames(spark, rows + odd, model)
    solved = antennas.solve_antennas(vis, predicted, CONFIG).collect()
    assert len(solved) == 18 and all(r.settled and r.n_in == 25 for r in solved)
    for t, g in gains.items():
        found = np.array([complex(r.gain_re, r.gain_im) for r in sorted(solved, key=lambda r: r.antenna) if r.time == t])
        assert np.allclose(found, g * np.conj(g[0]) / abs(g[0]), atol=1e-4)
    table = spark.createDataFrame(solved)
    residuals = {r.event_id: r for r in antennas.correct_antennas(vis, predicted, table, CONFIG).collect()}
    assert len(residuals) == len(rows) + 4
    assert all(abs(r.residual_re) <= 12 and abs(r.residual_im) <= 12 for i, r in residuals.items() if i >= 0)
    assert residuals[-1].residual_re is None and residuals[-2].residual_re is None and residuals[-3].pair is None
    assert residuals[-4].residual_im is None and residuals[-4].residual_re is not None


def test_noisy_gains_are_a_minimum(spark):
    _, model, rows = made_up(2, noise=20_000)
    solved = antennas.solve_antennas(*frames(spark, rows, model), CONFIG).where("time = 7").orderBy("antenna").collect()
    best = np.array([complex(r.gain_re, r.gain_im) for r in solved])

    def cost(g):
        p, q = (np.array([PAIRS[r[5] % 15][i] for r in rows if r[2] == 7]) for i in (0, 1))
        v = np.array([complex(r[6], r[7]) for r in rows if r[2] == 7])
        m = np.array([model[r[1]] for r in rows if r[2] == 7])
        return (abs(v - g[p] * np.conj(g[q]) * m) ** 2).sum()

    assert all(r.settled for r in solved)
    for i in range(6):
        for step in (1e-3, -1e-3, 1e-3j, -1e-3j):
            moved = best.copy()
            moved[i] += step
            assert cost(moved) > cost(best)


def test_unmeasured_antennas_and_separate_sets(spark):
    _, model, rows = made_up(3, without=(2,))
    solved = antennas.solve_antennas(*frames(spark, rows, model), CONFIG).collect()
    assert {r.antenna for r in solved} == {0, 1, 3, 4, 5}
    apart = [r for r in rows if PAIRS[r[5] % 15] in {(0, 1), (3, 4)}]
    solved = {(r.time, r.antenna): r for r in antennas.solve_antennas(*frames(spark, apart, model), CONFIG).collect()}
    assert all(abs(solved[t, a].gain_im) < 1e-9 for t in (0, 1, 7) for a in (0, 3))
    assert antennas.solve_antennas(*frames(spark, [], model), CONFIG).collect() == []


def test_hot_pair_is_summed_before_it_is_shuffled(spark):
    vis, predicted = frames(spark, [(i, i % 5, 0, 0, 0, 4, 5, 6) for i in range(1000)], {f: 1 + 1j for f in range(5)})
    sums = antennas.pair_sums(vis, predicted, CONFIG)
    assert "partial_sum" in sums._jdf.queryExecution().executedPlan().toString()
    row = sums.first()
    assert (row.pair, row.n_in, row.cross_re, row.cross_im, row.power) == (4, 1000, 11_000, 1000, 2000)


def test_a_pair_for_every_baseline():
    assert CONFIG.antenna_pairs == 15
    with pytest.raises(ValueError):
        ImagingConfig(cells=2, match_radius=1)
