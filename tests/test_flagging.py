"""Flags by runs against plain Python."""

from __future__ import annotations

import math
import random
from statistics import median

import pytest

from fringeflow import ImagingConfig
from fringeflow.operators import flagging

CELLS = "time int, frequency int, n_in bigint, amplitude bigint"


def plain(cells: dict, c: ImagingConfig) -> set:
    """Flagged (time, frequency) of amplitudes by (time, frequency)."""
    flagged: set = set()
    for _ in range(c.flag_rounds):
        left = [v for at, v in cells.items() if at not in flagged]
        if not left:
            return flagged
        middle = math.floor(median(left))
        limit = math.floor(median(abs(v - middle) for v in left) * c.flag_factor)
        for power, length in enumerate((1, 2, 4, 8)):
            for step in ((1, 0), (0, 1)):
                new = set()
                for t, f in cells:
                    run = [(t + i * step[0], f + i * step[1]) for i in range(length)]
                    if all(at in cells for at in run):
                        rest = [cells[at] - middle for at in run if at not in flagged]
                        if sum(rest) * 3**power > limit * 2**power * len(rest):
                            new |= set(run)
                flagged |= new
    return flagged


def check(spark, cells, config):
    got = flagging.flag_runs(spark.createDataFrame([(*at, 3, v) for at, v in cells.items()], CELLS), config).collect()
    assert len(got) == len(cells)
    found = {(r.time, r.frequency) for r in got if r.flag}
    assert found == plain(cells, config)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_flags_equal_plain_python(spark, seed):
    rnd = random.Random(seed)
    cells = {(t, f): rnd.randint(50, 150) for t in range(-3, 20) for f in range(12) if rnd.random() > 0.06}
    for t in range(4, 14):
        cells[t, 5] = 170 + rnd.randint(0, 30)
    cells[9, 9] = 5000
    found = check(spark, cells, ImagingConfig(flag_factor=5))
    assert (9, 9) in found and {(t, 5) for t in range(5, 13)} <= found and len(found) < len(cells) / 2


def test_weak_interference_is_found_by_its_length(spark):
    """A median deviation of 5; the limits are 30, 20, 13.3 and 8.9 over the median."""
    cells = {(t, f): 90 + (t * 8 + f * 13) % 21 for t in range(20) for f in range(10)}
    long, short = {(t, 4): 118 for t in range(10)}, {(15, 8): 118}
    found = check(spark, cells | long | short, ImagingConfig(flag_rounds=1))
    assert set(long) <= found and (15, 8) not in found
    assert (15, 8) in check(spark, cells | {(15, 8): 200}, ImagingConfig(flag_rounds=1))


def test_nothing_and_equal_cells(spark):
    assert flagging.flag_runs(spark.createDataFrame([], CELLS), ImagingConfig()).collect() == []
    assert check(spark, {(0, 0): 5}, ImagingConfig()) == set()
    assert check(spark, {(t, 0): 0 for t in range(9)}, ImagingConfig()) == set()
