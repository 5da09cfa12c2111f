"""One imaging cycle over a folder of input tables, as lazy stages."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from fringeflow.config import ImagingConfig
from fringeflow.operators import antennas, crossmatch, deconvolve, flagging, islands, kernels, stages
from fringeflow.sources import stage_store
from fringeflow.sources.tables import read_table
from fringeflow.sources.views import sky_model, telescope_config, visibilities


# Stages that ``store`` measures, by their name in reports.
REPORTED = {
    "rep": "reppre_ifft",
    "deg": "degkerupd_deg",
    "predicted": "pharotpre_dft_sumvis",
    "solutions": "solve",
    "cells": "grid",
}


class ImagingCycle:
    """Stages by name, each built when first used, from the stages it reads.

    The prediction and the solutions are barriers: every later stage needs
    all of them. They are small and are settled once per cycle, so no later
    stage predicts or solves again; using a later stage runs them. With
    ``store_cells`` the gridded cells and the image cells are settled too, for
    runs that take more than one result from them. ``close`` removes what a
    cycle has settled.

    ``events`` and ``catalogue`` stand in for the tables of the folder; a
    catalogue is what ``updated_lsm`` of an earlier cycle gave.
    """

    def __init__(
        self,
        spark: SparkSession,
        data_dir: str,
        config: ImagingConfig | None = None,
        store_cells: bool = False,
        events: DataFrame | None = None,
        catalogue: DataFrame | None = None,
    ) -> None:
        self.spark = spark
        self.data_dir = data_dir
        self.config = config or ImagingConfig()
        self.store_cells = store_cells
        self._events = events
        self._catalogue = catalogue
        self._settled: list[str] = []
        self._stored: set[str] = set()

    def settle(self, stage: DataFrame, name: str) -> DataFrame:
        path = stage_store.new_stage_path(self.spark, name)
        self._settled.append(path)
        stage_store.write_stage(stage, path)
        return stage_store.read_stage(self.spark, path, stage.schema)

    def store(self, *names: str) -> DataFrame:
        """Settle the named stages in order, and report ``stage, n_rows, n_in`` of each, measured as it is written.

        Later stages then read what is stored. Rows without ``n_in`` count as
        one input each.
        """
        rows = []
        for name in names:
            stage = getattr(self, name)
            path = stage_store.new_stage_path(self.spark, REPORTED[name])
            self._settled.append(path)
            n_in = "sum(n_in)" if "n_in" in stage.columns else "count(*)"
            measured = stage_store.write_measured(stage, path, n_rows="count(*)", n_in=f"coalesce({n_in}, 0L)")
            setattr(self, name, stage_store.read_stage(self.spark, path, stage.schema))
            self._stored.add(name)
            rows.append((REPORTED[name], measured["n_rows"], measured["n_in"]))
        return self.spark.createDataFrame(rows, "stage string, n_rows bigint, n_in bigint")

    def close(self) -> None:
        """Remove settled stages; results that read them can no longer run."""
        while self._settled:
            stage_store.remove_stage(self.spark, self._settled.pop())

    @cached_property
    def vis(self) -> DataFrame:
        events = self._events
        if events is None:
            events = read_table(self.spark, self.data_dir, "events")
        return visibilities(events, self.config)

    @cached_property
    def lsm(self) -> DataFrame:
        if self._catalogue is not None:
            return self._catalogue
        return sky_model(read_table(self.spark, self.data_dir, "part"), self.config)

    @cached_property
    def telescope(self) -> DataFrame:
        return telescope_config(read_table(self.spark, self.data_dir, "supplier"))

    @cached_property
    def channels(self) -> DataFrame:
        return stages.visibility_channels(self.vis)

    @cached_property
    def extracted(self) -> DataFrame:
        return stages.extract_lsm(self.lsm)

    @cached_property
    def extracted_block(self) -> DataFrame:
        return stages.extracted_block(self.extracted)

    @cached_property
    def telescope_block(self) -> DataFrame:
        return stages.telescope_data(self.telescope)

    @cached_property
    def rep(self) -> DataFrame:
        return stages.reppre_ifft(self.extracted, self.config)

    @cached_property
    def deg(self) -> DataFrame:
        return stages.degkerupd_deg(self.rep, self.telescope_block, self.config)

    @cached_property
    def predicted(self) -> DataFrame:
        return stages.pharotpre_dft_sumvis(self.deg, self.extracted_block, self.config)

    @cached_property
    def settled_predicted(self) -> DataFrame:
        return self.predicted if "predicted" in self._stored else self.settle(self.predicted, "pharotpre_dft_sumvis")

    @cached_property
    def slots(self) -> DataFrame:
        return stages.timeslots(self.vis, self.settled_predicted)

    @cached_property
    def solutions(self) -> DataFrame:
        return stages.solve(self.vis, self.settled_predicted)

    @cached_property
    def settled_solutions(self) -> DataFrame:
        return self.solutions if "solutions" in self._stored else self.settle(self.solutions, "solve")

    @cached_property
    def corrected(self) -> DataFrame:
        return stages.correct(self.vis, self.settled_predicted, self.settled_solutions)

    @cached_property
    def residuals(self) -> DataFrame:
        return stages.subtract_visibility(self.corrected)

    @cached_property
    def flagged(self) -> DataFrame:
        return stages.flag(self.residuals)

    @cached_property
    def cells(self) -> DataFrame:
        cells = stages.grid(self.flagged, self.telescope_block, self.config)
        return self.settle(cells, "grid") if self.store_cells else cells

    @cached_property
    def transformed(self) -> DataFrame:
        return kernels.facet_images(self.cells, self.config)

    @cached_property
    def image_cells(self) -> DataFrame:
        cells = stages.image_cells(self.transformed)
        return self.settle(cells, "sum_facets") if self.store_cells else cells

    @cached_property
    def images(self) -> DataFrame:
        return stages.sum_facets(self.image_cells)

    @cached_property
    def components(self) -> DataFrame:
        return stages.identify_component(self.image_cells)

    @cached_property
    def peaks(self) -> DataFrame:
        return stages.source_find(self.components, self.config)

    @cached_property
    def sources(self) -> DataFrame:
        """Islands of the mosaic, settled: labelling them takes several rounds."""
        return self.settle(islands.source_islands(self.image_cells, self.config), "source_find")

    @cached_property
    def remaining(self) -> DataFrame:
        return stages.subimacom(self.images, self.components)

    @cached_property
    def updated_lsm(self) -> DataFrame:
        return crossmatch.merge_catalogue(self.lsm, self.sources, self.config)

    @cached_property
    def spread(self) -> DataFrame:
        return deconvolve.point_spread(self.cells, self.config)

    @cached_property
    def minor_steps(self) -> DataFrame:
        """Residual images and components of the minor cycles, settled: both are read."""
        steps = deconvolve.minor_cycle(self.transformed, self.spread, self.config)
        return self.settle(steps, "minor_cycle")

    @cached_property
    def residual_images(self) -> DataFrame:
        return deconvolve.residual_image(self.minor_steps)

    @cached_property
    def clean_components(self) -> DataFrame:
        return deconvolve.clean_components(self.minor_steps)

    @cached_property
    def model_images(self) -> DataFrame:
        return deconvolve.model_image(self.minor_steps)

    @cached_property
    def antenna_gains(self) -> DataFrame:
        gains = antennas.solve_antennas(self.vis, self.settled_predicted, self.config)
        return self.settle(gains, "solve_antennas")

    @cached_property
    def antenna_residuals(self) -> DataFrame:
        return antennas.correct_antennas(self.vis, self.settled_predicted, self.antenna_gains, self.config)

    @cached_property
    def model_cells(self) -> DataFrame:
        """Visibility cells of the catalogue, settled: predictions are looked up in them."""
        return self.settle(kernels.model_cells(self.lsm, self.config), "model_cells")

    @cached_property
    def degridded(self) -> DataFrame:
        return kernels.predict_degridded(self.vis, self.model_cells, self.config)

    @cached_property
    def degridded_solutions(self) -> DataFrame:
        return self.settle(kernels.solve_degridded(self.degridded), "solve_degridded")

    @cached_property
    def degridded_residuals(self) -> DataFrame:
        return kernels.subtract_degridded(self.degridded, self.degridded_solutions)

    @cached_property
    def flagged_cells(self) -> DataFrame:
        return flagging.flag_runs(flagging.cell_amplitudes(self.residuals), self.config)

    @cached_property
    def flagged_by_runs(self) -> DataFrame:
        return flagging.flag_by_runs(self.residuals, self.flagged_cells)
