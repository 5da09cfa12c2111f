"""Run one imaging cycle: ``spark-submit`` arguments in, stored results out."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from fringeflow.config import ImagingConfig
from fringeflow.operators import dataflow, stages
from fringeflow.plans.imaging import ImagingCycle
from fringeflow.session import get_spark
from fringeflow.sources.stage_store import write_stage


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fringeflow", description=__doc__)
    parser.add_argument("data_dir", help="folder with events, part and supplier Parquet tables")
    parser.add_argument("out_dir", help="folder for the results")
    parser.add_argument("--facets", type=int, default=ImagingConfig.facets)
    parser.add_argument("--slots", type=int, default=ImagingConfig.slots)
    options = parser.parse_args(arguments)

    config = ImagingConfig(facets=options.facets, slots=options.slots)
    cycle = ImagingCycle(get_spark(), options.data_dir, config, store_cells=True)
    out = options.out_dir.rstrip("/")

    write_stage(cycle.flagged, f"{out}/cor_subvis_flag", ["frequency"], compact=True)
    write_stage(cycle.components, f"{out}/identify_component")
    write_stage(cycle.remaining, f"{out}/subimacom")
    write_stage(cycle.sources, f"{out}/source_find")
    write_stage(cycle.clean_components, f"{out}/minor_cycle_components")
    write_stage(cycle.residual_images, f"{out}/minor_cycle_residuals", ["facet"], compact=True)
    write_stage(cycle.updated_lsm, f"{out}/update_lsm")

    report = dataflow.stage_report(
        {
            "reppre_ifft": cycle.rep,
            "telescope_data": stages.telescope_data(cycle.telescope),
            "pharotpre_dft_sumvis": cycle.settled_predicted,
            "solve": cycle.settled_solutions,
            "grid": cycle.cells,
        }
    )
    report.orderBy("stage").show(truncate=False)


if __name__ == "__main__":
    main()
