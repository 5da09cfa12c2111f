"""Operations inside the composite stages: transforms, gridding and rotation.

All act on image cells, which the key domains bound, or are a row-level
lookup against such a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import idiv, key_mod, round_div, round_half_away, wide, wide_dot
from fringeflow.functions.twiddle import SCALE
from fringeflow.operators.dataflow import fan_out, group, index_grid
from fringeflow.operators.fourier import Pass, transform
from fringeflow.operators.stages import CELL, IMAGE, factors
from fringeflow.plans.joins import lookup


def reprojection(
    cells: DataFrame, config: ImagingConfig, axes: tuple[str, str] = ("u", "w"), values: tuple[str, ...] = ("re", "im")
) -> DataFrame:
    """Shift each facet's image by its facet number along the first axis."""
    first, second = axes
    shifted = cells.selectExpr(
        *IMAGE, f"{key_mod(f'{first} + facet', config.cells)} as {first}", second, *values
    )
    return group(shifted, [*IMAGE, *axes], *[f"sum({v}) as {v}" for v in values])


def facet_images(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Transform the gridded cells of every image, then reproject the result."""
    return reprojection(dft(cells, config), config, ("k", "l"))


# The passes of a transform. The divisors leave thousandths after the first
# forward pass and tenths after the first inverse one.
_ROWS = Pass("u", "w", "k", 1_000)
_COLUMNS = Pass("w", "k", "l", 1_000_000_000)
_BACK_COLUMNS = Pass("l", "k", "w", 100_000, inverse=True)


def dft_rows(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """First DFT pass, over ``u``; result scaled by 1e3."""
    return transform(cells, [_ROWS], config.cells)


def dft(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Forward two-dimensional DFT of every image, in cell units."""
    return transform(cells, [_ROWS, _COLUMNS], config.cells)


def idft_columns(spectrum: DataFrame, config: ImagingConfig) -> DataFrame:
    """First inverse pass, over ``l``; result scaled by 10."""
    return transform(spectrum, [_BACK_COLUMNS], config.cells)


def idft(spectrum: DataFrame, config: ImagingConfig) -> DataFrame:
    """Inverse two-dimensional DFT back to cells; every cell of an image is present."""
    back_rows = Pass("k", "w", "u", 10_000_000 * config.cells**2, inverse=True)
    return transform(spectrum, [_BACK_COLUMNS, back_rows], config.cells)


def phase_rotation(vis: DataFrame, config: ImagingConfig) -> DataFrame:
    """Rotate each visibility by the phase of its channel and facet; null where a part is missing."""
    cos, sin = factors("frequency", "facet", config.cells)
    return vis.selectExpr("event_id", f"re * {cos} - im * {sin} as re", f"re * {sin} + im * {cos} as im")


def kernel_spread(cells: DataFrame, values: list[str], config: ImagingConfig) -> DataFrame:
    """Copy each cell to its 3x3 neighbourhood, with ``weight`` 4, 2 or 1."""
    n = config.cells
    return fan_out(cells, {"du": 3, "dw": 3}).selectExpr(
        *IMAGE,
        f"{key_mod(f'u + du - 1 + {n}', n)} as u",
        f"{key_mod(f'w + dw - 1 + {n}', n)} as w",
        *values,
        "if(du = 1, 2, 1) * if(dw = 1, 2, 1) as weight",
    )


def convolve_grid(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Convolutional gridding: residuals spread over 3x3 cells.

    The spread is linear, so it is applied to summed cells and not to every
    measurement.
    """
    spread = kernel_spread(cells, ["re", "im", "n_in"], config)
    return group(spread, CELL, "sum(re * weight) as re", "sum(im * weight) as im", "sum(n_in) as n_in")


def degrid(vis: DataFrame, cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Model value of each measurement from the 3x3 cells around its own.

    The kernel is symmetric: the weighted sum around a cell is what reaches
    it when every cell is spread. That table has one row per cell, so each
    measurement needs a single lookup.
    """
    placed = vis.selectExpr("event_id", f"{_measured_cell('event_id', config)} as number")
    table = spread_table(cells, config)
    return lookup(placed, table, ["number"], bounded=True).select("event_id", "model_re", "model_im")


def spread_table(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Weighted sum of the 3x3 cells around each cell, by cell number."""
    parts = [f"sum({c} * weight) as model_{c}" for c in ("re", "im")]
    model = group(kernel_spread(cells, ["re", "im"], config), CELL, *parts)
    return model.selectExpr(f"{_cell_number('u', 'w', config)} as number", "model_re", "model_im")


def _measured_cell(event_id: str, config: ImagingConfig) -> str:
    n = config.cells
    return _cell_number(key_mod(event_id, n), key_mod(idiv(event_id, n), n), config)


def _cell_number(u: str, w: str, config: ImagingConfig) -> str:
    """The four cell dimensions as one number, for a lookup by a single integer key."""
    image = f"facet * {config.polarisations} + polarisation"
    return f"cast((({image}) * {config.cells} + {u}) * {config.cells} + {w} as bigint)"


# Sum of the weights of the 3x3 kernel.
KERNEL_WEIGHT = 16


def model_cells(lsm: DataFrame, config: ImagingConfig) -> DataFrame:
    """Visibility cells of the catalogue: fluxes summed into images, shifted back to each facet's own axis and transformed.

    Components without a flux or a place take no part. All polarisations see
    the same sky.
    """
    n = config.cells
    placed = lsm.where("flux is not null and facet is not null and u is not null and w is not null")
    shifted = placed.selectExpr("facet", f"{key_mod(f'u - facet % {n} + {n}', n)} as k", "w as l", "flux")
    images = group(shifted, ["facet", "k", "l"], "sum(flux) as re").selectExpr("*", "0L as im")
    return idft(fan_out(images, {"polarisation": config.polarisations}), config)


def predict_degridded(vis: DataFrame, cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """Prediction of each measurement: the model cells around its own, weighted by the kernel, at its channel's phase.

    Gridding turns measurements by the phase of channel and facet; this turns
    the model back. Rows without a cell in the model have none.
    """
    rows = vis.selectExpr("event_id", "frequency", "time", "facet", "polarisation", "re", "im")
    number = _measured_cell("event_id", config)
    seen = lookup(rows.selectExpr("*", f"{number} as number"), spread_table(cells, config), ["number"], bounded=True)
    cos, sin = factors("frequency", "facet", config.cells)
    turned = {"re": f"{wide('model_re')} * {cos} + {wide('model_im')} * {sin}", "im": f"{wide('model_im')} * {cos} - {wide('model_re')} * {sin}"}
    parts = [f"cast({round_div(f'({v})', SCALE * KERNEL_WEIGHT)} as bigint) as model_{c}" for c, v in turned.items()]
    return seen.selectExpr(*rows.columns, *parts)


def solve_degridded(predicted: DataFrame) -> DataFrame:
    """Real gain per timeslot between measurements and their own predictions, by least squares."""
    product = "coalesce(sum({} * {}), 0)".format
    cross = " + ".join(product(wide(c), wide(f"model_{c}")) for c in ("re", "im"))
    square = " + ".join(product(wide(f"model_{c}"), wide(f"model_{c}")) for c in ("re", "im"))
    gain = f"try_divide(cast({cross} as double), cast({square} as double)) as gain"
    return group(predicted, ["time"], gain, "count(*) as n_in")


def subtract_degridded(predicted: DataFrame, solved: DataFrame) -> DataFrame:
    """Residuals of measurements against their own predictions with the timeslot's gain, in whole cents."""
    seen = lookup(predicted, solved.select("time", "gain"), ["time"])
    parts = [f"{round_half_away(f'({c} - gain * model_{c})')} as residual_{c}" for c in ("re", "im")]
    return seen.selectExpr("event_id", "frequency", "time", *IMAGE, *parts)


def kernel_table(spark: SparkSession, config: ImagingConfig) -> DataFrame:
    """Gridding kernels: ``weight`` of the 3x3 cells around a measurement, by plane and place inside its cell.

    Along each axis a weight falls in line with the distance between the
    middle of a cell and the measurement's place, and reaches farther in
    higher planes. Distances count in halves of a place.
    """
    over = config.sub_cells
    dims = {"plane": config.w_planes, "su": over, "sw": over, "du": 3, "dw": 3}

    def along(d: str, s: str) -> str:
        return f"greatest(0, {2 * over} + plane - abs({2 * over} * ({d} - 1) - (2 * {s} + 1 - {over})))"

    return index_grid(spark, dims).selectExpr("plane", "su", "sw", "du", "dw", f"{along('du', 'su')} * {along('dw', 'sw')} as weight")


def grid_planes(flagged: DataFrame, config: ImagingConfig) -> DataFrame:
    """Gridding with the kernel of each measurement's plane and place inside its cell.

    The plane follows from the timeslot (the first one without a time).
    Unflagged residuals are summed per cell, plane, place and channel and
    turned by the phase of channel and facet; only these sums, which the
    configuration bounds, meet the kernels and are copied to the cells around.
    """
    n, over = config.cells, config.sub_cells
    place = {"u": "event_id", "w": idiv("event_id", n)}
    inside = {"su": idiv("event_id", n * n), "sw": idiv("event_id", n * n * over)}
    placed = flagged.where("facet is not null and polarisation is not null and event_id is not null").selectExpr(
        *IMAGE,
        *[f"{key_mod(v, n)} as {c}" for c, v in place.items()],
        *[f"{key_mod(v, over)} as {c}" for c, v in inside.items()],
        f"coalesce({key_mod('time', config.w_planes)}, 0) as plane",
        "frequency",
        *[f"if(flag, 0, coalesce(residual_{c}, 0)) as {c}" for c in ("re", "im")],
    )
    keys = [*CELL, "su", "sw", "plane"]
    sums = group(placed, [*keys, "frequency"], "sum(re) as re", "sum(im) as im", "count(*) as n_in")
    cos, sin = factors("frequency", "facet", n)
    turned = group(
        sums, keys, f"{wide_dot(('re', cos), ('im', f'-{sin}'))} as re", f"{wide_dot(('re', sin), ('im', cos))} as im", "sum(n_in) as n_in"
    )
    spread = lookup(turned, kernel_table(flagged.sparkSession, config), ["plane", "su", "sw"], bounded=True, how="inner")
    spread = spread.where("weight > 0").selectExpr(
        *IMAGE,
        *[f"{key_mod(f'{c} + d{c} - 1 + {n}', n)} as {c}" for c in ("u", "w")],
        *("re", "im", "n_in", "weight"),
    )
    totals = group(spread, CELL, "sum(re * weight) as re", "sum(im * weight) as im", "sum(n_in) as n_in")
    return totals.selectExpr(*CELL, *[f"cast({round_div(c, SCALE)} as bigint) as {c}" for c in ("re", "im")], "n_in")
