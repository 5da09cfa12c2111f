"""Lookups of row-level stages in small keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], bounded: bool = False, how: str = "left"
) -> DataFrame:
    """Join ``rows`` to ``table`` on equal keys, keeping rows without a match.

    ``bounded`` says that the keys come out of the configured domain by
    construction, so the table has at most as many rows as that; it is
    broadcast and ``rows`` are not shuffled. Without it the join is left to
    the planner and its size statistics, with adaptive skew splitting.
    """
    return rows.join(F.broadcast(table) if bounded else table, list(on), how)
