"""Visibility-imaging dataflow on Spark: keyed stages as DataFrames."""

from fringeflow.config import (
    NARROW_SNAPSHOT,
    WIDE_FACETS,
    WIDE_FACETS_TWELVE_SLOTS,
    ImagingConfig,
)
from fringeflow.plans.imaging import ImagingCycle

__all__ = [
    "ImagingConfig",
    "ImagingCycle",
    "NARROW_SNAPSHOT",
    "WIDE_FACETS",
    "WIDE_FACETS_TWELVE_SLOTS",
]
