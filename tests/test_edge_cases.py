"""Queries on a small fixture of awkward rows, against their SQL counterparts."""

from __future__ import annotations

import pytest
from compare import assert_same, duck

from fringeflow.oracle import ORACLE_SQL
from fringeflow.queries import QUERIES

EVENTS = """
select i as event_id, timestamp '2024-01-01' + interval (i * 4000) second as ts,
    case when i % 3 = 0 then 7 else i * 31 % 400 end as user_id,
    'view' as event_type, ((i * 7919) % 40000) / 100.0 as value,
    '{"k": ' || (i % 100) || '}' as props
from range(600) t(i)
-- ids and users below zero
union all select -i, timestamp '2024-01-05' + interval (i) hour, -i * 5, 'view', i * 1.25, '{"k": 1}'
from range(1, 60) t(i)
-- before and after the observation window
union all select 10000 + i, timestamp '2023-12-25 23:59:59.5' - interval (i) day, i, 'view', 3.5, '{"k": 2}'
from range(20) t(i)
union all select 20000 + i, timestamp '2024-03-01' + interval (i) day, i, 'view', 400.25, '{"k": 3}'
from range(20) t(i)
-- no value, no payload, payload without a number
union all select 30000 + i, timestamp '2024-01-02', 3, 'view', null, '{"k": 4}' from range(45) t(i)
union all select 40000 + i, timestamp '2024-01-02', 48, 'view', 1.0, null from range(5) t(i)
union all select 50000 + i, timestamp '2024-01-02', 48, 'view', 1.0, '{"k": "x"}' from range(5) t(i)
-- payloads in other forms
union all select 55000 + i, timestamp '2024-01-02', 47, 'view', 1.0, ['{"a": 1, "k": 7}', '{ "k" : 8 }',
    '{"k": -9}', '{"k": null}', '{"k": "12"}', '{"k":10}', '{"j": 5}', '[1]', '{"k": {"k": 3}}'][i + 1]
from range(9) t(i)
-- identical rows in pairs, and equal peaks of opposite sign in one facet
union all select 60000 + i // 2, timestamp '2024-01-03', 12, 'view', 5.0, '{"k": 5}' from range(40) t(i)
union all select 70000 + i, timestamp '2024-01-04', 20, 'view', 90000.0, '{"k": 6}' from range(8) t(i)
"""

# Catalogue entries for some facets only, some without a price.
PARTS = """
select i as p_partkey, 'p' as p_name, 'b' as p_brand, 't' as p_type, 1 as p_size,
    case when i % 10 = 0 then null else 900.0 + i / 10.0 end as p_retailprice
from range(400) t(i) where i % 49 < 30
"""

SUPPLIERS = """
select i as s_suppkey, 's' as s_name, 1 as s_nationkey, i * 1.005 - 3 as s_acctbal from range(9) t(i)
"""

NAMES = [
    "visibility_buffer",
    "local_sky_model",
    "telescope_management",
    "extract_lsm",
    "telescope_data",
    "reppre_ifft",
    "degkerupd_deg",
    "pharotpre_dft_sumvis",
    "timeslots",
    "solve",
    "solve_120",
    "correct",
    "subtract_visibility",
    "flag",
    "imaging_cycle",
    "cor_subvis_flag",
    "grid",
    "grid_convolved",
    "grid_planes",
    "stored_refreshed",
    "degrid",
    "sum_facets",
    "identify_component",
    "source_find",
    "subimacom",
    "update_lsm",
    "source_islands",
    "near_components",
    "point_spread",
    "minor_cycle_residuals",
    "minor_cycle_components",
    "antenna_pair_sums",
    "flag_runs",
    "flag_by_runs",
    "model_cells",
    "subtract_degridded",
    "fan_in_stored",
    "idft",
    "phase_rotation",
    "index_grid",
    "dep_edges",
    "fan_in_union",
    "cogroup_merge",
    "partition_by_dim",
    "partition_by_facet",
    "one_partition_per_key",
    "per_partition_map",
    "lineage_digest",
    "stage_lineage",
    "input_volume",
    "key_labels",
    "stored_by_channel",
]


@pytest.fixture(scope="module")
def fixture_dir(tmp_path_factory):
    import duckdb

    folder = tmp_path_factory.mktemp("awkward")
    for name, sql in (("events", EVENTS), ("part", PARTS), ("supplier", SUPPLIERS)):
        types = {
            "events": "event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type,"
            " value::double as value, props",
            "part": "* replace (p_partkey::bigint as p_partkey, p_size::int as p_size,"
            " p_retailprice::double as p_retailprice)",
            "supplier": "* replace (s_suppkey::bigint as s_suppkey, s_nationkey::int as s_nationkey,"
            " s_acctbal::double as s_acctbal)",
        }[name]
        duckdb.execute(f"copy (select {types} from ({sql}) t) to '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, fixture_dir, name):
    assert_same(QUERIES[name](spark, fixture_dir), duck(fixture_dir), ORACLE_SQL[name])


def test_slots_do_not_depend_on_session_time_zone(spark, fixture_dir):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert_same(QUERIES["solve"](spark, fixture_dir), duck(fixture_dir), ORACLE_SQL["solve"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
