"""Major loops: cycle after cycle, each from the catalogue of the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fringeflow.config import ImagingConfig
from fringeflow.operators.dataflow import group, union_all
from fringeflow.operators.stages import AMPLITUDE
from fringeflow.plans.imaging import ImagingCycle
from fringeflow.sources import stage_store


@dataclass(frozen=True)
class MajorLoops:
    """Rows of all loops, and the catalogue after the last of them."""

    report: DataFrame
    catalogue: DataFrame


def loop_report(cycle: ImagingCycle, updated: DataFrame, loop: int) -> DataFrame:
    """One row: catalogue before and after, sources found, and the amplitude of what is left unflagged."""
    left = group(cycle.flagged, [], f"cast(coalesce(sum(if(flag, 0, {AMPLITUDE})), 0) as bigint) as residual")
    sources = group(cycle.sources, [], "count(*) as n_sources", "coalesce(sum(flux), 0L) as source_flux")
    sizes = [group(frame, [], f"count(*) as {name}") for frame, name in ((cycle.lsm, "n_before"), (updated, "n_after"))]
    row = left
    for part in (sources, *sizes):
        row = row.withColumns({c: part.select(c).scalar() for c in part.columns})
    return row.selectExpr(f"{loop} as major_loop", "n_before", "n_after", "n_sources", "source_flux", "residual")


def run_major_loops(
    spark: SparkSession, data_dir: str, config: ImagingConfig | None = None, most: int = 9, stop_percent: int = 1
) -> MajorLoops:
    """Run cycles until a loop's residual is within ``stop_percent`` of the one before, ``most`` of them at most.

    What passes from loop to loop is the stored catalogue, so no loop's plan
    holds another's. A loop's other stages are removed when it is over; one
    number of each comes to the driver.
    """
    rows, catalogue, before = [], None, None
    for loop in range(most):
        cycle = ImagingCycle(spark, data_dir, config, store_cells=True, catalogue=catalogue)
        updated = stage_store.settle(cycle.updated_lsm, "update_lsm")
        row = stage_store.settle(loop_report(cycle, updated, loop), "major_loop")
        cycle.close()
        rows.append(row)
        catalogue, residual = updated, row.first()["residual"]
        if before is not None and abs(residual - before) * 100 <= stop_percent * before:
            break
        before = residual
    return MajorLoops(union_all(rows), catalogue)
