"""Every registered query equals its SQL counterpart: names, types and values."""

from __future__ import annotations

import pytest
from compare import assert_same, duck

from fringeflow.oracle import ORACLE_SQL
from fringeflow.queries import QUERIES


@pytest.fixture(scope="module")
def con(data_dir):
    return duck(data_dir)


# Iterations to convergence in floating point; test_antennas.py compares them with made-up gains.
BEYOND_SQL = {"solve_antennas", "correct_antennas"}


def test_every_other_query_has_sql():
    assert set(QUERIES) - BEYOND_SQL == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, con, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir), con, ORACLE_SQL[name])
