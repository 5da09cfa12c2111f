"""The seventeen stages of one imaging cycle.

Row-level work (predict, correct, flag) is a chain of lookups in small tables
without a shuffle; rows whose key is null or unknown stay, without a result.
Everything else first sums measurements to their key domain, with map-side
combining, and works on the bounded result. Visibilities are complex, as two
integer columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import idiv, key_mod, round_div, round_half_away, wide, wide_dot
from fringeflow.functions.twiddle import SCALE, cos_factor, sin_factor
from fringeflow.operators.dataflow import fan_out, first_per_key, group, refine
from fringeflow.plans.joins import lookup

IMAGE = ["facet", "polarisation"]
CELL = [*IMAGE, "u", "w"]

# Telescope gains are in millionths of the signal.
UNITY = 1_000_000


def extract_lsm(lsm: DataFrame) -> DataFrame:
    """Catalogue components that can be predicted: those with a flux."""
    return lsm.where("flux is not null")


def extracted_block(extracted: DataFrame) -> DataFrame:
    """Extracted components as one block per beam and major loop."""
    sums = group(extracted, ["beam"], "count(*) as n_in", "sum(flux) as flux")
    return sums.selectExpr("beam", "0 as major_loop", "n_in", "flux")


def visibility_channels(vis: DataFrame) -> DataFrame:
    """Visibility sums per fine channel."""
    return group(vis, ["frequency"], "sum(re) as re", "sum(im) as im", "count(*) as n_in")


def reppre_ifft(extracted: DataFrame, config: ImagingConfig) -> DataFrame:
    """Coarse model per (channel, facet, polarisation): 5 % less flux per channel.

    Components are reprojected, that is shifted by their facet along ``u``,
    and inversely transformed at the channel's place. The transform is linear
    and depends on ``u`` only, so fluxes are summed per (facet, u) before they
    are copied to the channels, and the result is copied to polarisations.
    """
    columns = group(extracted, ["facet", "u"], "sum(flux) as flux", "count(*) as n")
    copies = fan_out(columns, {"frequency": config.coarse_channels})
    cos, sin = factors("frequency", "(u + facet)", config.cells)
    sums = group(
        copies,
        ["frequency", "facet"],
        f"{wide_dot(('flux', cos))} as re",
        f"{wide_dot(('flux', sin))} as im",
        "sum(n) as n_in",
    )
    parts = [f"cast({round_div(c, SCALE)} as bigint) * (100 - 5 * frequency) as model_{c}" for c in ("re", "im")]
    blocks = fan_out(sums.selectExpr("frequency", "facet", *parts, "n_in"), {"polarisation": config.polarisations})
    return blocks.selectExpr("frequency", *IMAGE, "model_re", "model_im", "n_in")


def telescope_data(telescope: DataFrame) -> DataFrame:
    """Configuration summed into the one block all facets read."""
    sums = group(telescope, ["beam"], "count(*) as n_in", "sum(gain) as gain")
    return sums.selectExpr("beam", "0 as frequency", "0 as time", "0 as baseline", "n_in", "gain")


def _with_telescope(blocks: DataFrame, telescope_block: DataFrame) -> DataFrame:
    """Adds ``response``: the mean antenna gain on top of unity, one value for all blocks."""
    mean = telescope_block.selectExpr(idiv("gain", "n_in")).scalar()
    return blocks.withColumn("response", F.coalesce(mean, F.lit(0)) + UNITY)


def _scaled(value: str) -> str:
    return f"cast({idiv(f'{wide(value)} * response', UNITY)} as bigint)"


def degkerupd_deg(rep: DataFrame, telescope_block: DataFrame, config: ImagingConfig) -> DataFrame:
    """Fine model: linear interpolation between a coarse channel and the next, seen by the telescope."""
    step = config.refinement
    following = "coalesce(lead({0}) over (partition by facet, polarisation order by frequency), {0}) as next_{1}"
    pairs = rep.selectExpr("*", *[following.format(f"model_{c}", c) for c in ("re", "im")])
    fine = _with_telescope(refine(pairs, "frequency", step), telescope_block)
    between = {c: idiv(f"model_{c} * ({step} - part) + next_{c} * part", step) for c in ("re", "im")}
    fine = fine.selectExpr("frequency", *IMAGE, *[f"{v} as {c}" for c, v in between.items()], "response")
    return fine.selectExpr("frequency", *IMAGE, *[f"{_scaled(c)} as model_{c}" for c in ("re", "im")])


def pharotpre_dft_sumvis(deg: DataFrame, extracted_block: DataFrame, config: ImagingConfig) -> DataFrame:
    """Predicted visibility per fine channel.

    Images are rotated to their facet's phase and averaged; the mean
    component of the extracted catalogue adds the part all channels share.
    """
    cos, sin = factors("frequency", "facet", config.cells)
    mean = "cast({} div cast(count(*) * 10000 * 1000000 as decimal(20,0)) as bigint) as {}"
    sums = group(
        deg,
        ["frequency"],
        mean.format(wide_dot(("model_re", cos), ("model_im", f"-{sin}")), "re"),
        mean.format(wide_dot(("model_re", sin), ("model_im", cos)), "im"),
        "count(*) as n_images",
    )
    shared = extracted_block.selectExpr(idiv("flux", "n_in")).scalar()
    n_shared = extracted_block.selectExpr("1L").scalar()
    sums = sums.withColumn("mean_flux", F.coalesce(shared, F.lit(0))).withColumn("n_shared", F.coalesce(n_shared, F.lit(0)))
    return sums.selectExpr(
        "frequency", "re + mean_flux as model_re", "im as model_im", "n_images + n_shared as n_in"
    )


def _model(predicted: DataFrame) -> DataFrame:
    return predicted.select("frequency", "model_re", "model_im")


def timeslots(vis: DataFrame, predicted: DataFrame) -> DataFrame:
    """Measurements with their predicted value, keyed by timeslot."""
    paired = lookup(vis, _model(predicted), ["frequency"], bounded=True)
    return paired.select("time", "frequency", "re", "im", "model_re", "model_im")


def solve(vis: DataFrame, predicted: DataFrame) -> DataFrame:
    """Least-squares real gain per timeslot: sum(re*m_re + im*m_im) / sum(m_re^2 + m_im^2).

    ``m`` is constant within a channel, so measurements are summed per
    (time, frequency) first and only those sums meet the prediction. Rows
    without time or channel count in ``n_in`` and in no sum.
    """
    sums = group(vis, ["time", "frequency"], "sum(re) as re", "sum(im) as im", "count(*) as n")
    paired = lookup(sums, _model(predicted), ["frequency"], bounded=True)
    product = "coalesce(sum({} * {}), 0)".format
    cross = " + ".join(product(wide(c), wide(f"model_{c}")) for c in ("re", "im"))
    square = " + ".join(f"{wide(f'model_{c}')} * {wide(f'model_{c}')}" for c in ("re", "im"))
    power = f"sum(({square}) * {wide('n')})"
    gain = f"try_divide(cast({cross} as double), cast({power} as double)) as gain"
    return group(paired, ["time"], gain, "sum(n) as n_in")


def correct(vis: DataFrame, predicted: DataFrame, solved: DataFrame) -> DataFrame:
    """Measurements with their prediction corrected by the timeslot's gain.

    ``solved`` has one row per timeslot present in the data, which the
    configuration does not bound: pass a settled table.
    """
    paired = lookup(vis, _model(predicted), ["frequency"], bounded=True)
    paired = lookup(paired, solved.select("time", "gain"), ["time"])
    parts = [f"gain * model_{c} as corrected_{c}" for c in ("re", "im")]
    return paired.selectExpr("event_id", "frequency", "time", *IMAGE, "re", "im", *parts)


def subtract_visibility(corrected: DataFrame) -> DataFrame:
    """Residual of every measurement, in whole cents."""
    parts = [f"{round_half_away(f'({c} - corrected_{c})')} as residual_{c}" for c in ("re", "im")]
    return corrected.selectExpr("event_id", "frequency", "time", *IMAGE, *parts)


AMPLITUDE = "(abs(residual_re) + coalesce(abs(residual_im), 0))"


def flag(residuals: DataFrame) -> DataFrame:
    """Flag residuals above twice their channel's mean amplitude.

    ``a * n > 2 * sum(a)`` over integers equals ``a > floor(2 * sum / n)``:
    one limit per channel, looked up, in place of a window over all rows of a
    channel. A row without residual has no flag.
    """
    limits = group(residuals, ["frequency"], f"{idiv(f'sum({AMPLITUDE}) * 2', 'count(*)')} as limit")
    paired = lookup(residuals, limits, ["frequency"], bounded=True)
    return paired.selectExpr(*residuals.columns, f"{AMPLITUDE} > limit as flag")


def flag_counts(flagged: DataFrame) -> DataFrame:
    """Measurements and flagged measurements per channel."""
    return group(flagged, ["frequency"], "count(*) as n_in", "count_if(flag) as n_flagged")


def grid(flagged: DataFrame, telescope_block: DataFrame, config: ImagingConfig) -> DataFrame:
    """Unflagged residuals rotated to their facet's phase, seen by the telescope, summed into image cells.

    Flagged rows are counted and add nothing. The phase depends on channel
    and facet, so residuals are summed per cell and channel before they are
    rotated. Rows without a place in an image are left out.
    """
    n = config.cells
    placed = flagged.selectExpr(
        *IMAGE,
        f"{key_mod('event_id', n)} as u",
        f"{key_mod(idiv('event_id', n), n)} as w",
        "frequency",
        *[f"if(flag, 0, coalesce(residual_{c}, 0)) as {c}" for c in ("re", "im")],
        "flag",
    ).where(" and ".join(f"{c} is not null" for c in CELL))
    sums = group(
        placed, [*CELL, "frequency"], "sum(re) as re", "sum(im) as im", "count(*) as n_in", "count_if(flag) as n_flagged"
    )
    cos, sin = factors("frequency", "facet", n)
    rotated = group(
        sums,
        CELL,
        f"{wide_dot(('re', cos), ('im', f'-{sin}'))} as re",
        f"{wide_dot(('re', sin), ('im', cos))} as im",
        "sum(n_in) as n_in",
        "sum(n_flagged) as n_flagged",
    )
    parts = [f"cast({round_div(c, SCALE)} as bigint) as {c}" for c in ("re", "im")]
    seen = _with_telescope(rotated.selectExpr(*CELL, *parts, "n_in", "n_flagged"), telescope_block)
    return seen.selectExpr(*CELL, *[f"{_scaled(c)} as {c}" for c in ("re", "im")], "n_in", "n_flagged")


def image_cells(images: DataFrame) -> DataFrame:
    """Brightness of the cells of transformed images."""
    return images.selectExpr(*IMAGE, "k as u", "l as w", "abs(re) + abs(im) as cell")


def sum_facets(cells: DataFrame) -> DataFrame:
    """Image brightness per facet and polarisation."""
    return group(cells, IMAGE, "cast(sum(cell) as bigint) as flux", "count(*) as n_cells")


def identify_component(cells: DataFrame) -> DataFrame:
    """Strongest cell of each facet; ties by polarisation, u, w, empty cells last."""
    order = ["-coalesce(abs(cell), -1)", "polarisation", "u", "w"]
    return first_per_key(cells, ["facet"], order, ["polarisation", "u", "w", "cell"])


def source_find(components: DataFrame, config: ImagingConfig) -> DataFrame:
    """Peaks of facets that are strong enough to be sources."""
    found = components.where(f"abs(cell) > {config.peak_threshold}")
    return found.selectExpr("facet", "u", "w", "cast(cell as bigint) as flux")


def source_catalog(sources: DataFrame) -> DataFrame:
    """All found sources as one catalogue block."""
    keyed = sources.selectExpr("0 as beam", "0 as major_loop", "flux")
    return group(keyed, ["beam", "major_loop"], "count(*) as n_in", "sum(flux) as flux")


def subimacom(images: DataFrame, components: DataFrame) -> DataFrame:
    """Image brightness left after removing the facet's component from its image."""
    joined = lookup(images, components.select(*IMAGE, "cell"), IMAGE, bounded=True)
    return joined.selectExpr(*IMAGE, "cast(flux - coalesce(cell, 0) as bigint) as residual")


def subimacom_facets(remaining: DataFrame) -> DataFrame:
    """``subimacom`` keyed by facet alone: its polarisation images as one block."""
    return group(remaining, ["facet"], "sum(residual) as residual", "count(*) as n_images")


def factors(k: str, x: str, n: int) -> tuple[str, str]:
    return cos_factor(k, x, n), sin_factor(k, x, n)
