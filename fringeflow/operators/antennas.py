"""Complex gains per antenna, from measurements whose baselines name antenna pairs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import key_mod, round_half_away, wide
from fringeflow.operators.dataflow import group
from fringeflow.plans.joins import lookup

# Largest change, as a share of the largest gain, at which a timeslot is solved, and rounds at most.
SETTLED_CHANGE = 1e-9
ROUNDS = 2000

GAINS_SCHEMA = "time int, antenna int, gain_re double, gain_im double, n_in bigint, rounds int, settled boolean"


def antenna_pair(baseline: str, config: ImagingConfig) -> str:
    """Number of a baseline's antenna pair; a null baseline has none."""
    return key_mod(baseline, config.antenna_pairs)


def pair_sums(vis: DataFrame, predicted: DataFrame, config: ImagingConfig) -> DataFrame:
    """All that the gains depend on, per timeslot and pair: sum of measurement times conjugate model, and of model power.

    The model is constant within a channel, so measurements are summed per
    (time, pair, channel) before they meet it. What is left has at most
    ``antenna_pairs`` rows a timeslot. Rows without a time, pair or
    predicted channel take no part, and those without a part of their value add nothing.
    """
    keyed = vis.selectExpr("time", f"{antenna_pair('baseline', config)} as pair", "frequency", "re", "im")
    keyed = keyed.where("time is not null and pair is not null and frequency is not null")
    measured = "coalesce(sum(if(im is not null, re, null)), 0) as re", "coalesce(sum(if(re is not null, im, null)), 0) as im"
    sums = group(keyed, ["time", "pair", "frequency"], *measured, "count(re + im) as n")
    paired = lookup(sums, predicted.select("frequency", "model_re", "model_im"), ["frequency"], bounded=True, how="inner")
    times = lambda a, b: f"{wide(a)} * {wide(b)}"
    return group(
        paired,
        ["time", "pair"],
        f"cast(sum({times('re', 'model_re')} + {times('im', 'model_im')}) as double) as cross_re",
        f"cast(sum({times('im', 'model_re')} - {times('re', 'model_im')}) as double) as cross_im",
        f"cast(sum(({times('model_re', 'model_re')} + {times('model_im', 'model_im')}) * {wide('n')}) as double) as power",
        "sum(n) as n_in",
    )


def solve_antennas(vis: DataFrame, predicted: DataFrame, config: ImagingConfig) -> DataFrame:
    """Gains ``g`` of each timeslot, so that ``g_p * conj(g_q) * model`` is nearest to the measurements of pair p, q.

    Alternating least squares: with all other gains held, each antenna's own
    has a closed form; every second round goes half way. The phase of the
    first antenna of each connected set of antennas is 0. A timeslot is one
    group of at most ``antenna_pairs`` rows. Antennas without a measurement
    have no row; ``settled`` tells whether the last round changed nothing.
    """
    pairs = np.array(list(combinations(range(config.antennas), 2)))

    def run(slot: pa.Table) -> pa.Table:
        slot = slot.sort_by("pair")
        p, q = pairs[slot["pair"].to_numpy()].T
        cross = slot["cross_re"].to_numpy() + 1j * slot["cross_im"].to_numpy()
        power, count = slot["power"].to_numpy(), slot["n_in"].to_numpy()
        size = config.antennas
        a, b, n = np.zeros((size, size), complex), np.zeros((size, size)), np.zeros((size, size), np.int64)
        a[p, q], a[q, p] = cross, cross.conj()
        b[p, q] = b[q, p] = power
        n[p, q] = n[q, p] = count
        gains, rounds, settled = alternate(a, b)
        used = np.flatnonzero(b.sum(axis=1) > 0)
        arrays = [
            pa.array(np.full(len(used), slot["time"][0].as_py() if len(used) else 0, dtype=np.int32)),
            pa.array(used.astype(np.int32)),
            pa.array(gains[used].real),
            pa.array(gains[used].imag),
            pa.array(n.sum(axis=1)[used]),
            pa.array(np.full(len(used), rounds, dtype=np.int32)),
            pa.array([settled] * len(used), pa.bool_()),
        ]
        return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in GAINS_SCHEMA.split(", ")])

    return pair_sums(vis, predicted, config).groupBy("time").applyInArrow(run, GAINS_SCHEMA)


def alternate(cross: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """Gains for Hermitian ``cross`` and symmetric ``power``, the rounds they took, and whether they settled."""
    gains = np.ones(len(cross), dtype=complex) * np.sqrt(np.abs(cross).sum() / power.sum() if power.sum() else 1)
    rounds, settled = 0, False
    while rounds < ROUNDS and not settled:
        weight = power @ np.abs(gains) ** 2
        new = np.divide(cross @ gains, weight, out=np.zeros_like(gains), where=weight > 0)
        settled = bool(np.abs(new - gains).max() <= SETTLED_CHANGE * np.abs(new).max())
        gains = (new + gains) / 2 if rounds % 2 else new
        rounds += 1
    for first, members in _connected(power > 0):
        phase = gains[first] / abs(gains[first]) if gains[first] else 1
        gains[members] *= np.conj(phase)
    return gains, rounds, settled


def _connected(touch: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Sets of antennas that measurements tie together, with their first one."""
    reach = touch | np.eye(len(touch), dtype=bool)
    for _ in range(len(touch).bit_length()):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    firsts = np.unique(reach.argmax(axis=1))
    return [(int(f), np.flatnonzero(reach[f])) for f in firsts]


def pair_gains(gains: DataFrame, config: ImagingConfig) -> DataFrame:
    """``time, pair, gain_re, gain_im``: product of the first antenna's gain with the conjugate of the second's."""
    ends = list(combinations(range(config.antennas), 2))
    p, q = (f"array({', '.join(str(end[i]) for end in ends)})" for i in (0, 1))
    first = gains.selectExpr("time", "antenna as p", "gain_re as p_re", "gain_im as p_im")
    second = gains.selectExpr("time", "antenna as q", "gain_re as q_re", "gain_im as q_im")
    domain = first.selectExpr("*", f"explode(sequence(0, {config.antenna_pairs - 1})) as pair").where(f"get({p}, pair) = p")
    both = domain.selectExpr("*", f"get({q}, pair) as q").join(second, ["time", "q"])
    return both.selectExpr("time", "pair", "p_re * q_re + p_im * q_im as gain_re", "p_im * q_re - p_re * q_im as gain_im")


def correct_antennas(vis: DataFrame, predicted: DataFrame, gains: DataFrame, config: ImagingConfig) -> DataFrame:
    """Residuals of all measurements against the prediction seen through both antennas' gains, in whole cents.

    ``gains`` is settled and has no bound from the configuration, as
    timestamps may lie anywhere. Rows without a pair or a gain stay, with null
    residuals.
    """
    pair = antenna_pair("baseline", config)
    rows = vis.selectExpr("event_id", "frequency", "time", "facet", "polarisation", "re", "im", f"{pair} as pair")
    model = predicted.select("frequency", "model_re", "model_im")
    seen = lookup(lookup(rows, model, ["frequency"], bounded=True), pair_gains(gains, config), ["time", "pair"])
    parts = {
        "re": "(re - (gain_re * model_re - gain_im * model_im))",
        "im": "(im - (gain_re * model_im + gain_im * model_re))",
    }
    residuals = [f"{round_half_away(v)} as residual_{c}" for c, v in parts.items()]
    return seen.selectExpr("event_id", "frequency", "time", "facet", "polarisation", "pair", *residuals)
