"""Measurement, catalogue and configuration views over the input tables.

Each view is one narrow projection; consumers that use few of its columns
scan only the input columns behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import idiv, key_mod, round_half_away
from fringeflow.functions.payload import json_int
from fringeflow.functions.timeslot import timeslot


def visibilities(events: DataFrame, config: ImagingConfig) -> DataFrame:
    """One measurement per event; amounts in cents. ``event_id`` identifies it."""
    return events.selectExpr(
        "event_id",
        "0 as beam",
        f"{key_mod('event_id', config.channels)} as frequency",
        f"{timeslot('ts', config.start, config.slot_seconds)} as time",
        "user_id as baseline",
        f"{key_mod('user_id', config.facets)} as facet",
        f"{key_mod(idiv('event_id', config.channels), config.polarisations)} as polarisation",
        f"{round_half_away('(value * 100)')} as re",
        f"{json_int('props', 'k')} as im",
    )


def sky_model(part: DataFrame, config: ImagingConfig) -> DataFrame:
    """One catalogue component per part; flux in cents, place as an image cell."""
    return part.selectExpr(
        "p_partkey as comp_id",
        "0 as beam",
        f"{key_mod('p_partkey', config.facets)} as facet",
        f"{round_half_away('(p_retailprice * 100)')} as flux",
        f"{key_mod('p_partkey', config.cells)} as u",
        f"{key_mod(idiv('p_partkey', config.cells), config.cells)} as w",
    )


def telescope_config(supplier: DataFrame) -> DataFrame:
    """One antenna per supplier; gain in cents."""
    return supplier.selectExpr(
        "s_suppkey as antenna_id", "0 as beam", f"{round_half_away('(s_acctbal * 100)')} as gain"
    )
