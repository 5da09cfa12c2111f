"""Registered queries: every operator over the whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fringeflow.config import NARROW_SNAPSHOT, WIDE_FACETS, WIDE_FACETS_TWELVE_SLOTS, ImagingConfig
from fringeflow.functions.digest import digest
from fringeflow.functions.numeric import idiv, key_mod, round_half_away
from fringeflow.operators import antennas, crossmatch, dataflow, kernels, stages
from fringeflow.operators.refresh import refresh_stage
from fringeflow.plans.imaging import ImagingCycle
from fringeflow.plans.joins import lookup
from fringeflow.plans.major import run_major_loops
from fringeflow.sources import stage_store
from fringeflow.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

COARSE_DIMS = ("beam", "major_loop", "frequency", "time", "facet", "polarisation")


def _on_cycle(
    build: Callable[[ImagingCycle], DataFrame],
    config: ImagingConfig = NARROW_SNAPSHOT,
    store_cells: bool = False,
) -> Query:
    return lambda spark, data_dir: build(ImagingCycle(spark, data_dir, config, store_cells))


# Key domains, with the rows that fall on each key


def index_grid(cycle: ImagingCycle) -> DataFrame:
    """Coarse key domain with the catalogue components each key is built from."""
    c = cycle.config
    sizes = (1, 1, c.coarse_channels, 1, c.facets, c.polarisations)
    domain = dataflow.index_grid(cycle.spark, dict(zip(COARSE_DIMS, sizes)))
    inputs = dataflow.group(cycle.lsm, ["facet"], "count(*) as n_in")
    joined = lookup(domain, inputs, ["facet"], bounded=True)
    return joined.selectExpr(*COARSE_DIMS, "coalesce(n_in, 0L) as n_in")


def dep_edges(cycle: ImagingCycle) -> DataFrame:
    """Fine keys, the coarse and configuration keys they read, and their measurements."""
    c = cycle.config
    dims = {"frequency": c.channels, "facet": c.facets, "polarisation": c.polarisations}
    edges = dataflow.dep_edges(
        dataflow.index_grid(cycle.spark, dims),
        src_frequency=idiv("frequency", c.refinement),
        tel_frequency=idiv("frequency", c.channels),
    )
    inputs = dataflow.group(cycle.vis, list(dims), "count(*) as n_in")
    joined = lookup(edges, inputs, list(dims), bounded=True)
    return joined.selectExpr(*edges.columns, "coalesce(n_in, 0L) as n_in")


# Fan-out and fan-in


def fan_out(cycle: ImagingCycle) -> DataFrame:
    """Each channel's visibility block copied to all timeslots that read it."""
    return dataflow.fan_out(cycle.channels, {"time": cycle.config.slots})


def refine(cycle: ImagingCycle) -> DataFrame:
    """Coarse model blocks copied to their fine channels."""
    return dataflow.refine(cycle.rep, "frequency", cycle.config.refinement)


def fan_in_group(cycle: ImagingCycle) -> DataFrame:
    return dataflow.fan_in_group(cycle.vis, ["facet"], n_in="count(*)", re="sum(re)")


def _solution_total(cycle: ImagingCycle) -> DataFrame:
    """All solutions summed before they are copied to the channels that read them."""
    gain = f"sum({round_half_away('(gain * 1000000)')})"
    total = dataflow.collapse_global(cycle.solutions, val=gain, n_in="count(*)")
    return dataflow.fan_out(total, {"frequency": cycle.config.channels})


def fan_in_union(cycle: ImagingCycle) -> DataFrame:
    """Model, visibility and solutions of each channel gathered by union."""
    sources = {
        "model": cycle.settled_predicted.selectExpr("frequency", "model_re as val"),
        "vis": cycle.channels.selectExpr("frequency", "re as val"),
        "solve": _solution_total(cycle),
    }
    return dataflow.fan_in_union(sources, ["frequency"], "val")


def fan_in_zip2(cycle: ImagingCycle) -> DataFrame:
    model = cycle.predicted.select("frequency", "model_re", "model_im")
    return dataflow.fan_in_zip(["frequency"], cycle.channels, model)


def fan_in_zip3(cycle: ImagingCycle) -> DataFrame:
    model = cycle.settled_predicted.select("frequency", "model_re", "model_im")
    solved = _solution_total(cycle).selectExpr("frequency", "val as gain_micro")
    return dataflow.fan_in_zip(["frequency"], cycle.channels, model, solved)


def fan_in_stored(cycle: ImagingCycle) -> DataFrame:
    """Measurements, their own predictions and their residuals, stored in buckets by id and zipped in place."""
    stages_by_name = {
        "vis": cycle.vis.select("event_id", "re", "im"),
        "model": cycle.degridded.select("event_id", "model_re", "model_im"),
        "residual": cycle.degridded_residuals.select("event_id", "residual_re", "residual_im"),
    }
    buckets = int(cycle.spark.conf.get("spark.sql.shuffle.partitions"))
    return dataflow.fan_in_stored(["event_id"], stages_by_name, buckets)


def cogroup_merge(cycle: ImagingCycle) -> DataFrame:
    """Catalogue and measurements of each facet side by side."""
    catalogue = dataflow.group(cycle.lsm, ["facet"], "count(*) as n_components", "sum(flux) as flux")
    measured = dataflow.group(cycle.vis, ["facet"], "count(*) as n_measured", "sum(re) as re")
    return dataflow.cogroup_merge(catalogue, measured, ["facet"])


def broadcast_lookup(cycle: ImagingCycle) -> DataFrame:
    rows = cycle.vis.select("event_id", "frequency", "re", "im")
    model = cycle.predicted.select("frequency", "model_re", "model_im")
    return dataflow.broadcast_lookup(rows, model, ["frequency"])


# Placement: whole measurements stored by key, so that a reader of one key opens its folder only


def _placed_by(*dims: str) -> Callable[[ImagingCycle], DataFrame]:
    def placed(cycle: ImagingCycle) -> DataFrame:
        path = stage_store.new_stage_path(cycle.spark, f"by_{'_'.join(dims)}")
        stage_store.write_stage(cycle.vis, path, dims, compact=True)
        stored = stage_store.read_stage(cycle.spark, path, cycle.vis.schema)
        return dataflow.group(stored, list(dims), "count(*) as n_in", "sum(re) as re", "sum(im) as im")

    return placed


# Mapping, reuse and accounting


def per_partition_map(cycle: ImagingCycle) -> DataFrame:
    """Sums, peak and count per channel, with a partial result for each partition."""
    return dataflow.fan_in_group(cycle.vis, ["frequency"], re="sum(re)", peak="max(re)", n_in="count(*)")


def first_per_key(cycle: ImagingCycle) -> DataFrame:
    return dataflow.first_per_key(cycle.vis, ["frequency"], ["event_id"], ["event_id", "re"])


def per_row_map(cycle: ImagingCycle) -> DataFrame:
    """Keys re-labelled per measurement: drop the baseline, add the coarse channel."""
    step = cycle.config.refinement
    return dataflow.per_row_map(
        cycle.vis,
        *("event_id", "time", "facet", "polarisation"),
        src_frequency=f"cast({idiv('frequency', step)} as int)",
        part=f"frequency % {step}",
        amount="greatest(re, 4L)",
    )


def collapse_global(cycle: ImagingCycle) -> DataFrame:
    return dataflow.collapse_global(
        cycle.vis, n_in="count(*)", re="sum(re)", first_id="min(event_id)", last_id="max(event_id)"
    )


def stage_cache(cycle: ImagingCycle) -> DataFrame:
    """Channel sums kept once and read twice: as blocks and as their total."""
    blocks = dataflow.stage_cache(cycle.channels, "visibility_channels")
    total = dataflow.collapse_global(blocks, re="sum(re)", im="sum(im)", n_in="sum(n_in)")
    return blocks.unionByName(total.selectExpr("-1 as frequency", "re", "im", "n_in"))


def stage_count(cycle: ImagingCycle) -> DataFrame:
    """Rows of each stage; those of stored stages are counted while they are written."""
    inputs = {"visibility_buffer": cycle.vis, "local_sky_model": cycle.lsm, "telescope_management": cycle.telescope}
    counted = dataflow.stage_count(inputs)
    return counted.unionByName(cycle.store("rep", "deg", "predicted", "solutions").selectExpr("stage", "n_rows"))


def imaging_cycle(cycle: ImagingCycle) -> DataFrame:
    """Rows, flagged rows and total of each result of a cycle."""
    results = {
        "cor_subvis_flag": (cycle.flagged, "count_if(flag)", "sum(residual_re)"),
        "grikerupd_pharot_grid_fft_rep": (cycle.cells, "sum(n_flagged)", "sum(re)"),
        "subimacom": (stages.subimacom_facets(cycle.remaining), "0L", "sum(residual)"),
        "update_lsm": (cycle.updated_lsm, "0L", "sum(flux)"),
    }
    rows = [
        dataflow.collapse_global(frame, n_rows="count(*)", n_flagged=flagged, total=total).selectExpr(
            f"'{name}' as stage", "n_rows", "n_flagged", "total"
        )
        for name, (frame, flagged, total) in results.items()
    ]
    return dataflow.union_all(rows)


def missing_keys(spark: SparkSession, data_dir: str) -> DataFrame:
    """Measurements of which some have no id or no time: none is lost on the way to the flags."""
    keyless = read_table(spark, data_dir, "events").selectExpr(
        "if(event_id % 10 = 0, null, event_id) as event_id",
        "if(event_id % 7 = 0, null, ts) as ts",
        *("user_id", "event_type", "value", "props"),
    )
    cycle = ImagingCycle(spark, data_dir, events=keyless)
    flagged = dataflow.fan_in_group(
        cycle.flagged,
        ["time"],
        n_in="count(*)",
        n_residuals="count(residual_re)",
        n_flags="count(flag)",
        residual="sum(residual_re)",
    )
    solved = cycle.solutions.selectExpr("time as solved_time", "n_in as n_solved")
    return flagged.join(solved, flagged["time"].eqNullSafe(solved["solved_time"]), "left").drop("solved_time")


def lineage_digest(cycle: ImagingCycle) -> DataFrame:
    return dataflow.lineage_digest(cycle.vis, ["frequency"], ["event_id", "re"])


def stage_lineage(cycle: ImagingCycle) -> DataFrame:
    """Rows and digest of the stages' results, to tell whether two runs agree."""
    image = ["facet", "polarisation"]
    return dataflow.stage_digest(
        {
            "extract_lsm": (cycle.extracted, ["comp_id", "flux"]),
            "local_sky_model": (cycle.lsm, ["comp_id", "flux"]),
            "telescope_management": (cycle.telescope, ["antenna_id", "gain"]),
            "visibility_buffer": (cycle.vis, ["event_id", "re", "im"]),
            "reppre_ifft": (cycle.rep, ["frequency", *image, "model_re", "model_im"]),
            "telescope_data": (cycle.telescope_block, ["n_in", "gain"]),
            "degkerupd_deg": (cycle.deg, ["frequency", *image, "model_re", "model_im"]),
            "pharotpre_dft_sumvis": (cycle.settled_predicted, ["frequency", "model_re", "model_im"]),
            "solve": (cycle.settled_solutions, ["time", "n_in"]),
            "cor_subvis_flag": (cycle.flagged, ["event_id", "residual_re", "residual_im"]),
            "grikerupd_pharot_grid_fft_rep": (cycle.cells, [*image, "u", "w", "re", "im"]),
            "sum_facets": (cycle.images, [*image, "flux"]),
            "identify_component": (cycle.components, ["facet", "u", "w", "cell"]),
            "source_find": (cycle.sources, ["facet", "flux"]),
            "subimacom": (cycle.remaining, [*image, "residual"]),
            "update_lsm": (cycle.updated_lsm, ["comp_id", "flux"]),
        }
    )


def input_volume(spark: SparkSession, data_dir: str) -> DataFrame:
    channel = f"{key_mod('event_id', NARROW_SNAPSHOT.channels)} as frequency"
    rows = read_table(spark, data_dir, "events").selectExpr(channel, "props")
    return dataflow.input_volume(rows, ["frequency"], "props")


def stage_report(cycle: ImagingCycle) -> DataFrame:
    """Blocks and inputs per stage and in total, measured while the stages are written."""
    return dataflow.report_total(cycle.store("rep", "predicted", "solutions", "cells"))


def key_labels(cycle: ImagingCycle) -> DataFrame:
    """Rendered keys: label, digest in hex, length, and a dimension parsed back."""
    rendered = ", ".join(f"cast({c} as string)" for c in ("beam", "frequency", "time", "polarisation"))
    named = cycle.vis.selectExpr("event_id", "re", f"concat_ws('_', {rendered}) as label")
    code = digest("label")
    return named.selectExpr(
        "event_id",
        "label",
        f"hex({code}) as code",
        f"{code} ^ event_id as mixed",
        "cast(octet_length(label) as bigint) as n_bytes",
        "substring(label, 1, 4) as head",
        "cast(split(label, '_')[1] as int) as frequency",
        f"{idiv('greatest(4L, re)', 1000)} as kilo",
    )


# Stored stages


def stored_by_channel(cycle: ImagingCycle) -> DataFrame:
    """All measurements stored per channel, read back and summed per timeslot and channel."""
    path = stage_store.new_stage_path(cycle.spark, "visibility_buffer")
    stage_store.write_stage(cycle.vis, path, ["frequency"], compact=True)
    stored = stage_store.read_stage(cycle.spark, path, cycle.vis.schema)
    return dataflow.group(stored, ["time", "frequency"], "sum(re) as re", "sum(im) as im", "count(*) as n_in")


def stored_one_channel(cycle: ImagingCycle) -> DataFrame:
    """One key of a stored stage: only its directory is read."""
    path = stage_store.new_stage_path(cycle.spark, "visch")
    stage_store.write_stage(cycle.channels, path, ["frequency"])
    return stage_store.read_stage(cycle.spark, path, cycle.channels.schema, frequency=3)


def stored_replaced(cycle: ImagingCycle) -> DataFrame:
    """Stored model blocks of the last coarse channel replaced; the others stay."""
    dims = ["frequency"]
    path = stage_store.new_stage_path(cycle.spark, "reppre_ifft")
    last = cycle.config.coarse_channels - 1
    negated = ["-model_re as model_re", "-model_im as model_im"]
    changed = cycle.rep.where(f"frequency = {last}").selectExpr("frequency", *stages.IMAGE, *negated, "n_in")
    stage_store.write_stage(cycle.rep, path, dims)
    stage_store.write_stage(changed, path, dims, replace=True)
    return stage_store.read_stage(cycle.spark, path, cycle.rep.schema)


def stored_refreshed(cycle: ImagingCycle) -> DataFrame:
    """Channel sums stored from measurements of which one channel's differ, then refreshed: that channel alone is built anew."""
    path = stage_store.new_stage_path(cycle.spark, "visibility_channels")
    columns = ["event_id", "re", "im"]
    older = cycle.vis.selectExpr("event_id", "frequency", "re + if(frequency = 3, 1, 0) as re", "im")
    refresh_stage(older, path, ["frequency"], columns, stages.visibility_channels)
    changes = refresh_stage(cycle.vis, path, ["frequency"], columns, stages.visibility_channels)
    stored = stage_store.read_stage(cycle.spark, path, cycle.channels.schema)
    refreshed = changes.selectExpr("frequency as changed", "state")
    marked = stored.join(refreshed, stored["frequency"].eqNullSafe(refreshed["changed"]), "left").drop("changed")
    return marked.selectExpr("frequency", "re", "im", "n_in", "state")


def stored_solve_by_time(cycle: ImagingCycle) -> DataFrame:
    """Solutions stored per timeslot and read back whole."""
    path = stage_store.new_stage_path(cycle.spark, "solve")
    stage_store.write_stage(cycle.solutions, path, ["time"], compact=True)
    return stage_store.read_stage(cycle.spark, path, cycle.solutions.schema)


def stored_prediction_by_channel(cycle: ImagingCycle) -> DataFrame:
    """Predictions stored per channel; one channel read back."""
    path = stage_store.new_stage_path(cycle.spark, "pharotpre_dft_sumvis")
    stage_store.write_stage(cycle.predicted, path, ["frequency"])
    return stage_store.read_stage(cycle.spark, path, cycle.predicted.schema, frequency=7)


def stored_model_by_key(cycle: ImagingCycle) -> DataFrame:
    """Model blocks stored by facet, sorted by the other dimensions; one facet read back.

    A folder for each key would hold one row. In a facet's file, row groups
    are skipped by the minima and maxima of the sorted dimensions.
    """
    path = stage_store.new_stage_path(cycle.spark, "reppre_ifft")
    placed = cycle.rep.repartition("facet").sortWithinPartitions("facet", "frequency", "polarisation")
    stage_store.write_stage(placed, path, ["facet"])
    return stage_store.read_stage(cycle.spark, path, cycle.rep.schema, facet=3)


def next_cycle(spark: SparkSession, data_dir: str) -> DataFrame:
    """Prediction of a second cycle that starts from the first one's stored catalogue."""
    first = ImagingCycle(spark, data_dir)
    path = stage_store.write_stage(first.updated_lsm, stage_store.new_stage_path(spark, "update_lsm"))
    catalogue = stage_store.read_stage(spark, path, first.lsm.schema)
    return ImagingCycle(spark, data_dir, catalogue=catalogue).predicted


def major_loops(spark: SparkSession, data_dir: str) -> DataFrame:
    """Two major loops; the second reads the first one's catalogue."""
    return run_major_loops(spark, data_dir, most=2).report


def spectrum(cycle: ImagingCycle) -> DataFrame:
    return kernels.dft(cycle.cells, cycle.config)


QUERIES: dict[str, Query] = {
    # Stages
    "extract_lsm": _on_cycle(lambda c: c.extracted_block),
    "local_sky_model": _on_cycle(lambda c: c.lsm),
    "telescope_management": _on_cycle(lambda c: c.telescope),
    "visibility_buffer": _on_cycle(lambda c: c.vis),
    "reppre_ifft": _on_cycle(lambda c: c.rep),
    "telescope_data": _on_cycle(lambda c: c.telescope_block),
    "degkerupd_deg": _on_cycle(lambda c: c.deg),
    "pharotpre_dft_sumvis": _on_cycle(lambda c: c.predicted),
    "timeslots": _on_cycle(lambda c: c.slots),
    "solve": _on_cycle(lambda c: c.solutions),
    "cor_subvis_flag": _on_cycle(lambda c: c.flagged),
    "grikerupd_pharot_grid_fft_rep": _on_cycle(lambda c: c.transformed),
    "sum_facets": _on_cycle(lambda c: c.images),
    "identify_component": _on_cycle(lambda c: c.components),
    "find_sources": _on_cycle(lambda c: c.peaks),
    "source_islands": _on_cycle(lambda c: c.sources),
    "source_find": _on_cycle(lambda c: stages.source_catalog(c.sources)),
    "subimacom": _on_cycle(lambda c: c.remaining, store_cells=True),
    "subimacom_facets": _on_cycle(lambda c: stages.subimacom_facets(c.remaining), store_cells=True),
    "update_lsm": _on_cycle(lambda c: c.updated_lsm),
    "near_components": _on_cycle(lambda c: crossmatch.near_components(c.lsm, c.sources, c.config)),
    "point_spread": _on_cycle(lambda c: c.spread),
    "minor_cycle_components": _on_cycle(lambda c: c.clean_components),
    "minor_cycle_residuals": _on_cycle(lambda c: c.residual_images),
    "minor_cycle_model": _on_cycle(lambda c: c.model_images),
    "solve_antennas": _on_cycle(lambda c: c.antenna_gains),
    "antenna_pair_sums": _on_cycle(lambda c: antennas.pair_sums(c.vis, c.settled_predicted, c.config)),
    "correct_antennas": _on_cycle(lambda c: c.antenna_residuals),
    # Operations inside the composite stages
    "reprojection": _on_cycle(lambda c: kernels.reprojection(c.cells, c.config)),
    "dft_rows": _on_cycle(lambda c: kernels.dft_rows(c.cells, c.config)),
    "dft": _on_cycle(spectrum),
    "idft_columns": _on_cycle(lambda c: kernels.idft_columns(spectrum(c), c.config)),
    "idft": _on_cycle(lambda c: kernels.idft(spectrum(c), c.config)),
    "degrid": _on_cycle(lambda c: kernels.degrid(c.vis, c.cells, c.config)),
    "model_cells": _on_cycle(lambda c: c.model_cells),
    "predict_degridded": _on_cycle(lambda c: c.degridded),
    "solve_degridded": _on_cycle(lambda c: c.degridded_solutions),
    "subtract_degridded": _on_cycle(lambda c: c.degridded_residuals),
    "phase_rotation": _on_cycle(lambda c: kernels.phase_rotation(c.vis, c.config)),
    "sum_visibilities": _on_cycle(lambda c: c.channels),
    "correct": _on_cycle(lambda c: c.corrected),
    "subtract_visibility": _on_cycle(lambda c: c.residuals),
    "flag": _on_cycle(lambda c: stages.flag_counts(c.flagged)),
    "flag_runs": _on_cycle(lambda c: c.flagged_cells),
    "flag_by_runs": _on_cycle(lambda c: c.flagged_by_runs),
    "grid": _on_cycle(lambda c: c.cells),
    "grid_planes": _on_cycle(lambda c: kernels.grid_planes(c.flagged, c.config)),
    "grid_convolved": _on_cycle(lambda c: kernels.convolve_grid(c.cells, c.config)),
    # Dataflow operators
    "index_grid": _on_cycle(index_grid),
    "dep_edges": _on_cycle(dep_edges),
    "fan_out": _on_cycle(fan_out),
    "refine": _on_cycle(refine),
    "fan_in_group": _on_cycle(fan_in_group),
    "fan_in_union": _on_cycle(fan_in_union),
    "fan_in_zip2": _on_cycle(fan_in_zip2),
    "fan_in_zip3": _on_cycle(fan_in_zip3),
    "fan_in_stored": _on_cycle(fan_in_stored),
    "cogroup_merge": _on_cycle(cogroup_merge),
    "broadcast_lookup": _on_cycle(broadcast_lookup),
    "partition_by_dim": _on_cycle(_placed_by("frequency")),
    "partition_by_facet": _on_cycle(_placed_by("facet")),
    "one_partition_per_key": _on_cycle(_placed_by("facet", "polarisation")),
    "per_partition_map": _on_cycle(per_partition_map),
    "first_per_key": _on_cycle(first_per_key),
    "per_row_map": _on_cycle(per_row_map),
    "collapse_global": _on_cycle(collapse_global),
    "stage_cache": _on_cycle(stage_cache),
    "stage_count": _on_cycle(stage_count),
    "missing_keys": missing_keys,
    "imaging_cycle": _on_cycle(imaging_cycle, store_cells=True),
    "lineage_digest": _on_cycle(lineage_digest),
    "stage_lineage": _on_cycle(stage_lineage, store_cells=True),
    "input_volume": input_volume,
    "stage_report": _on_cycle(stage_report),
    "key_labels": _on_cycle(key_labels),
    # Stored stages
    "stored_by_channel": _on_cycle(stored_by_channel),
    "stored_one_channel": _on_cycle(stored_one_channel),
    "stored_replaced": _on_cycle(stored_replaced),
    "stored_refreshed": _on_cycle(stored_refreshed),
    "stored_solve_by_time": _on_cycle(stored_solve_by_time),
    "stored_prediction_by_channel": _on_cycle(stored_prediction_by_channel),
    "stored_model_by_key": _on_cycle(stored_model_by_key),
    "next_cycle": next_cycle,
    "major_loops": major_loops,
    # The wider key domains
    "index_grid_81": _on_cycle(index_grid, WIDE_FACETS),
    "dep_edges_81": _on_cycle(dep_edges, WIDE_FACETS),
    "solve_120": _on_cycle(lambda c: c.solutions, WIDE_FACETS),
    "solve_12": _on_cycle(lambda c: c.solutions, WIDE_FACETS_TWELVE_SLOTS),
    "sum_facets_81": _on_cycle(lambda c: c.images, WIDE_FACETS),
    "identify_component_81": _on_cycle(lambda c: c.components, WIDE_FACETS),
    "subimacom_81": _on_cycle(lambda c: c.remaining, WIDE_FACETS, store_cells=True),
    "update_lsm_81": _on_cycle(lambda c: c.updated_lsm, WIDE_FACETS),
    "stage_lineage_81": _on_cycle(stage_lineage, WIDE_FACETS, store_cells=True),
    "reppre_ifft_81": _on_cycle(lambda c: c.rep, WIDE_FACETS),
    "degkerupd_deg_81": _on_cycle(lambda c: c.deg, WIDE_FACETS),
    "pharotpre_dft_sumvis_81": _on_cycle(lambda c: c.predicted, WIDE_FACETS),
    "timeslots_120": _on_cycle(lambda c: c.slots, WIDE_FACETS),
    "timeslots_12": _on_cycle(lambda c: c.slots, WIDE_FACETS_TWELVE_SLOTS),
    "cor_subvis_flag_81": _on_cycle(lambda c: c.flagged, WIDE_FACETS),
    "grikerupd_pharot_grid_fft_rep_81": _on_cycle(lambda c: c.transformed, WIDE_FACETS),
    "source_find_81": _on_cycle(lambda c: stages.source_catalog(c.sources), WIDE_FACETS),
    "fan_out_120": _on_cycle(fan_out, WIDE_FACETS),
}
