"""Minor cycles: take the components of an image out of it, one after the other.

Facets do not depend on each other; each is one group of at most
``polarisations * cells**2`` rows, whatever the size of the measurements.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fringeflow.config import ImagingConfig
from fringeflow.functions.twiddle import SCALE
from fringeflow.operators.dataflow import group
from fringeflow.operators.fourier import PART_BITS, rounded_quotient
from fringeflow.operators.kernels import dft
from fringeflow.operators.stages import CELL, IMAGE

STEPS_SCHEMA = "facet int, polarisation int, u int, w int, step int, value bigint"


def point_spread(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Image of a source of strength one at the centre: the transform of the unflagged measurements per cell."""
    return dft(cells.selectExpr(*CELL, "n_in - n_flagged as re", "0L as im"), config)


def minor_cycle(images: DataFrame, spread: DataFrame, config: ImagingConfig) -> DataFrame:
    """Components and residuals of ``images(facet, polarisation, k, l, re)``.

    The strongest cell of a facet, over its polarisations, gives a component
    of ``minor_gain_percent`` of its value. The point-spread image, in
    millionths of its centre, is shifted there, multiplied by it and
    subtracted from the image. This goes on until no cell is over the limit:
    ``minor_stop_percent`` of the first peak, or ``peak_threshold`` if that
    is more. ``minor_iterations`` ends a facet that does not get there. Of
    equal cells the first by polarisation, u, w counts.

    Rows with ``step`` 0 are the cells of the residual image; the others are
    components in the order in which they were found. An image without any
    unflagged measurement has no point-spread image and stays as it is.
    """
    n = config.cells

    def run(image: pa.Table, spread: pa.Table) -> pa.Table:
        names = np.unique(image["polarisation"].to_numpy())
        residual = _cube(image, names, n)
        shape = _in_millionths(_cube(spread, names, n))
        found = list(_steps(residual, shape, config))
        at = [*np.unravel_index(np.arange(residual.size), residual.shape)]
        step = np.zeros(residual.size, dtype=np.int64)
        if found:
            number, place, flux = map(np.array, zip(*found))
            at = [np.r_[a, b] for a, b in zip(at, np.unravel_index(place, residual.shape))]
            step, value = np.r_[step, number], np.r_[residual.ravel(), flux]
        else:
            value = residual.ravel()
        facet = np.full(len(step), image["facet"][0].as_py())
        keys = [facet, names[at[0]], at[1], at[2], step]
        arrays = [*[pa.array(x.astype(np.int32)) for x in keys], pa.array(value)]
        return pa.Table.from_arrays(arrays, names=["facet", "polarisation", "u", "w", "step", "value"])

    def none_or_run(image: pa.Table, spread: pa.Table) -> pa.Table:
        if not image.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int32())] * 5 + [pa.array([], pa.int64())], names=["facet", "polarisation", "u", "w", "step", "value"])
        return run(image, spread)

    wanted = [*IMAGE, "k", "l", "re"]
    grouped = [frame.select(*wanted).groupBy("facet") for frame in (images, spread)]
    return grouped[0].cogroup(grouped[1]).applyInArrow(none_or_run, STEPS_SCHEMA)


def _cube(image: pa.Table, names: np.ndarray, n: int) -> np.ndarray:
    """Values by polarisation, k, l; 0 where there is no row."""
    cube = np.zeros((len(names), n, n), dtype=np.int64)
    known = np.isin(image["polarisation"].to_numpy(), names)
    at = np.searchsorted(names, image["polarisation"].to_numpy()[known])
    cube[at, image["k"].to_numpy()[known], image["l"].to_numpy()[known]] = image["re"].to_numpy()[known]
    return cube


def _in_millionths(spread: np.ndarray) -> np.ndarray:
    """Point-spread images divided by their centre; all 0 where that is 0."""
    out = np.zeros_like(spread)
    for image, shape in zip(spread, out):
        if centre := int(image[0, 0]):
            shape[:] = rounded_quotient([image * SCALE], centre)
    return out


def _steps(residual: np.ndarray, shape: np.ndarray, config: ImagingConfig):
    """Number, place and flux of each component; changes ``residual``."""
    limit = None
    for number in range(1, config.minor_iterations + 1):
        place = int(np.abs(residual).argmax())
        peak = int(residual.flat[place])
        if limit is None:
            limit = max(config.peak_threshold, abs(peak) * config.minor_stop_percent // 100)
        image, u, w = np.unravel_index(place, residual.shape)
        flux = abs(peak) * config.minor_gain_percent // 100 * (-1 if peak < 0 else 1)
        if abs(peak) <= limit or not flux or not shape[image].any():
            return
        residual[image] -= times_millionths(flux, np.roll(shape[image], (u, w), axis=(0, 1)))
        yield number, place, flux


def times_millionths(flux: int, share: np.ndarray) -> np.ndarray:
    """``flux * share / 1e6``, exactly, halves away from zero."""
    parts = [(flux & ((1 << PART_BITS) - 1)) * share, (flux >> PART_BITS) * share]
    return rounded_quotient(parts, SCALE)


def residual_image(steps: DataFrame) -> DataFrame:
    """What is left of the images."""
    return steps.where("step = 0").selectExpr(*CELL, "value as residual")


def clean_components(steps: DataFrame) -> DataFrame:
    """The components of all facets, in the order of each facet's steps."""
    return steps.where("step > 0").selectExpr(*CELL, "step", "value as flux")


def model_image(steps: DataFrame) -> DataFrame:
    """Components summed into the cells they lie in."""
    return group(clean_components(steps), CELL, "sum(flux) as flux", "count(*) as n_components")
