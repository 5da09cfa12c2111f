from __future__ import annotations

import pytest
from compare import assert_same, duck

from fringeflow.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir), duck(data_dir), ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
