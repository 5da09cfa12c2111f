"""Fetch the rows of a large table whose keys are listed in another."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.sources.stage_store import settle

# Keys to broadcast at most; a hundred bytes each in memory.
BROADCAST_KEYS = 1_000_000


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """The table settled, with a hint to broadcast it if it has at most ``BROADCAST_KEYS`` rows."""
    table = settle(table, "lookup")
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def rows_with_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` whose columns ``on`` equal a row of ``keys``, nulls included.

    The keys are counted first. Up to a million distinct ones are broadcast,
    so that ``rows`` stay where they are; more are left to a shuffled join.
    """
    wanted = small_or_shuffled(keys.select(*[F.col(c).alias(f"_wanted_{c}") for c in on]).distinct())
    same = [F.col(c).eqNullSafe(F.col(f"_wanted_{c}")) for c in on]
    return rows.join(wanted, reduce(lambda a, b: a & b, same), "left_semi")
