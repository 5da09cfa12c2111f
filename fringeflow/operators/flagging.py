"""Flags by runs: sums over growing runs of timeslots and of channels, against the median."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import idiv
from fringeflow.operators.dataflow import group
from fringeflow.operators.stages import AMPLITUDE
from fringeflow.plans.joins import lookup
from fringeflow.sources.stage_store import settle

# Run lengths, each with a limit two thirds of the one before.
RUNS = (1, 2, 4, 8)


def cell_amplitudes(residuals: DataFrame) -> DataFrame:
    """Mean amplitude of the residuals of each timeslot and channel; rows without either, or without a residual, take no part."""
    known = residuals.where("time is not null and frequency is not null and residual_re is not null")
    mean = idiv(f"sum({AMPLITUDE})", "count(*)")
    return group(known, ["time", "frequency"], "count(*) as n_in", f"{mean} as amplitude")


def flag_runs(cells: DataFrame, config: ImagingConfig) -> DataFrame:
    """``cells(time, frequency, n_in, amplitude)`` with ``flag``.

    A run of 1, 2, 4 or 8 neighbouring timeslots of a channel, or channels of
    a timeslot, is flagged where the cells of it that are not flagged yet are
    in the mean over the median of all such cells by more than the limit:
    ``flag_factor`` times their median deviation, and a third less for each
    doubling of the run. So weak interference shows by its length. Runs do
    not reach over missing cells. All of it is done ``flag_rounds`` times,
    each with the medians of what is left.

    Windows run over the cells of one channel or one timeslot, of which there
    is one for each key, however many measurements.
    """
    found = settle(cells.selectExpr("*", "false as flag"), "cells")
    for _ in range(config.flag_rounds):
        left = found.where("not flag")
        middle = left.selectExpr("cast(floor(median(amplitude)) as bigint)").scalar()
        spread = left.withColumn("middle", middle)
        limit = spread.selectExpr(f"cast(floor(median(abs(amplitude - middle)) * {config.flag_factor}) as bigint)").scalar()
        marked = found.withColumn("middle", middle).withColumn("limit", limit)
        for power, length in enumerate(RUNS):
            for along, across in (("time", "frequency"), ("frequency", "time")):
                marked = _flag_one(marked, along, across, power, length)
        found = settle(marked.drop("middle", "limit"), "cells")
    return found


def _flag_one(cells: DataFrame, along: str, across: str, power: int, length: int) -> DataFrame:
    run = f"over (partition by {across} order by {along} rows between current row and {length - 1} following)"
    whole = f"count(*) {run} = {length} and max({along}) {run} - min({along}) {run} = {length - 1}"
    over = f"sum(if(flag, 0L, amplitude - middle)) {run} * {3**power} > limit * {2**power} * sum(if(flag, 0, 1)) {run}"
    columns = [c for c in cells.columns if c != "flag"]
    hit = cells.selectExpr(*cells.columns, f"{whole} and {over} as hit")
    reached = f"max(hit) over (partition by {across} order by {along} rows between {length - 1} preceding and current row)"
    return hit.selectExpr(*columns, f"flag or coalesce({reached}, false) as flag")


def flag_by_runs(residuals: DataFrame, cells: DataFrame) -> DataFrame:
    """Residuals with the flag of their timeslot and channel; null where they have none.

    The settled cells have no bound from the configuration, as timestamps may
    lie anywhere; the planner broadcasts them if they are small.
    """
    return lookup(residuals, cells.select("time", "frequency", "flag"), ["time", "frequency"])
