"""Two-dimensional transforms of whole images, as exact integer matrix products.

An image comes together once, as an array, and both passes run on it; no cell
is copied to the places it adds to. Twiddle factors are millionths, sums are
exact, and each pass ends in a division that rounds halves away from zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fringeflow.functions.twiddle import SCALE

IMAGE = ["facet", "polarisation"]

# Values are cut into parts of so many bits, so that products with factors and
# their sums stay below 2**53 and are exact in floating point.
PART_BITS = 20
PARTS = 4
# Longest axis for which that holds, and for which a remainder of the last
# division and a part have room in 64 bits.
LONGEST = 512


@dataclass(frozen=True)
class Pass:
    """One axis replaced by its transform; ``kept`` is the other axis."""

    axis: str
    kept: str
    onto: str
    divisor: int
    inverse: bool = False


def transform(images: DataFrame, passes: Sequence[Pass], cells: int) -> DataFrame:
    """All passes over each image of ``images(facet, polarisation, <two axes>, re, im)``.

    A place of the kept axis without any cell gives no result; an image has
    at most ``cells**2`` rows, whatever the size of the measurements.
    """
    if cells > LONGEST:
        raise ValueError(f"images of more than {LONGEST} cells on a side are not transformed exactly")
    first, last = passes[0], passes[-1]
    axes = sorted((last.onto, last.kept), key="kulw".index)

    def run(image: pa.Table) -> pa.Table:
        at = [image[c].to_numpy() for c in (first.axis, first.kept)]
        values = np.zeros((2, cells, cells), dtype=np.int64)
        for part, name in zip(values, ("re", "im")):
            part[at[0], at[1]] = image[name].to_numpy()
        # The first pass gives rows only where the kept axis has cells; later ones have all of theirs.
        places = np.unique(at[1])
        for step in passes:
            values = _one_pass(values, step, cells)
            if step is not last:
                values, places = values.transpose(0, 2, 1), np.arange(cells)
        onto = np.repeat(np.arange(cells, dtype=np.int32), len(places))
        kept = np.tile(places.astype(np.int32), cells)
        columns = {last.onto: onto, last.kept: kept}
        size = len(onto)
        keys = [pa.array(np.full(size, image[c][0].as_py(), dtype=np.int32)) for c in IMAGE]
        found = [pa.array(part[:, places].ravel()) for part in values]
        return pa.Table.from_arrays([*keys, *[pa.array(columns[a]) for a in axes], *found], names=[*IMAGE, *axes, "re", "im"])

    schema = ", ".join(f"{c} int" for c in [*IMAGE, *axes]) + ", re bigint, im bigint"
    columns = [*IMAGE, first.axis, first.kept, "re", "im"]
    return images.select(*columns).groupBy(*IMAGE).applyInArrow(run, schema)


def factors(cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of each pair of places, in millionths."""
    turns = 2 * np.pi * np.arange(cells) / cells
    wave = [np.array([round(x * SCALE) for x in f(turns)], dtype=np.float64) for f in (np.cos, np.sin)]
    product = np.outer(np.arange(cells), np.arange(cells)) % cells
    return wave[0][product], wave[1][product]


def _one_pass(values: np.ndarray, step: Pass, cells: int) -> np.ndarray:
    cos, sin = factors(cells)
    re, im = values
    sign = -1 if step.inverse else 1
    return np.stack(
        [
            rounded_quotient(exact_products((cos, re), (sign * sin, im)), step.divisor),
            rounded_quotient(exact_products((cos, im), (-sign * sin, re)), step.divisor),
        ]
    )


def exact_products(*terms: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Sum of the matrix products ``factor @ value``, as parts of ``PART_BITS`` bits each, lowest first.

    ``value`` holds 64-bit integers; each part's product is exact.
    """
    parts = []
    for i in range(PARTS):
        total = np.zeros(())
        for factor, value in terms:
            part = value >> (PART_BITS * i)
            if i < PARTS - 1:
                part = part & ((1 << PART_BITS) - 1)
            total = total + factor @ part.astype(np.float64)
        parts.append(total.astype(np.int64))
    return parts


def rounded_quotient(parts: list[np.ndarray], divisor: int) -> np.ndarray:
    """``value / divisor`` of a number in parts, halves away from zero; raises beyond 64 bits."""
    # Long division from the highest part; remainders are not negative.
    half = divisor // 2
    quotient, rest = np.zeros_like(parts[0]), np.zeros_like(parts[0])
    high = np.zeros(parts[0].shape)
    for part in reversed(parts):
        now = rest * (1 << PART_BITS) + part
        digit, rest = np.divmod(now, divisor)
        high = high * (1 << PART_BITS) + digit
        quotient = quotient * (1 << PART_BITS) + digit
    if (np.abs(high) >= 2.0**63).any():
        raise OverflowError("a transformed cell is beyond 64 bits")
    negative = high < 0
    # The floor of a negative value moves up where its rest is over half.
    return quotient + np.where(negative, rest > half, rest >= half + divisor % 2).astype(np.int64)
