"""Physical plans: what is scanned, shuffled and broadcast."""

from __future__ import annotations

import re

import pytest
from compare import spark_rows

from fringeflow import ImagingCycle
from fringeflow.operators import dataflow, kernels, stages
from fringeflow.plans import joins
from fringeflow.queries import QUERIES
from fringeflow.sources import stage_store


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_plan(frame) -> str:
    """The plan up to the row-level scan, without the broadcast tables."""
    kept, skip = [], None
    for line in plan(frame).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth > skip:
            continue
        skip = None
        if "BroadcastExchange" in line:
            skip = depth
            continue
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def cycle(spark, data_dir):
    return ImagingCycle(spark, data_dir)


@pytest.fixture(scope="module")
def stored(spark, data_dir):
    return ImagingCycle(spark, data_dir, store_cells=True)


@pytest.mark.parametrize("stage", ["slots", "residuals", "flagged"])
def test_row_level_stages_do_not_shuffle_rows(cycle, stage):
    text = rows_plan(getattr(cycle, stage))
    assert "Exchange" not in text
    assert "BroadcastHashJoin" in text


def test_degrid_looks_each_row_up_once(cycle, stored):
    text = rows_plan(kernels.degrid(cycle.vis, stored.cells, stored.config))
    assert "Exchange" not in text and text.count("BroadcastHashJoin") == 1


def test_scan_reads_needed_columns_only(cycle):
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(cycle.solutions))
    assert "struct<event_id:bigint,ts:timestamp_ntz,value:double,props:string>" in schemas


@pytest.mark.parametrize("stage", ["channels", "solutions", "cells", "rep"])
def test_aggregates_combine_before_the_shuffle(cycle, stage):
    text = plan(getattr(cycle, stage))
    assert "partial_sum" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_first_per_key_hashes(cycle):
    text = plan(dataflow.first_per_key(cycle.vis, ["frequency"], ["event_id"], ["event_id", "re"]))
    assert "partial_min_by" in text and "SortAggregate" not in text and "Sort [" not in text


def test_transform_shuffles_cells_once(stored):
    config = stored.config
    # No copy of a cell for each place it adds to, and both passes of a transform in one step.
    text = plan(kernels.idft(kernels.dft(stored.cells, config), config))
    assert text.count("Exchange") == text.count("FlatMapGroupsInArrow") == 2 and "Generate" not in text


def test_stored_key_prunes_directories(spark, data_dir):
    text = plan(QUERIES["stored_one_channel"](spark, data_dir))
    assert re.search(r"PartitionFilters: \[[^\]]*frequency#\d+ = 3", text)


def test_stored_rows_are_rebalanced_by_size(cycle, spark):
    staged = cycle.vis.select("event_id", "frequency").hint("rebalance", "frequency")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(staged)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_joins_without_keys(spark, data_dir, name):
    text = plan(QUERIES[name](spark, data_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_bounded_lookups_are_broadcast_by_hint(spark):
    rows = spark.range(1000).selectExpr("id % 9 as k", "id")
    table = spark.range(7).selectExpr("id as k", "id * 2 as v")
    bounded = joins.lookup(rows, table, ["k"], bounded=True)
    assert "ResolvedHint" in bounded._jdf.queryExecution().analyzed().toString()
    planned = joins.lookup(rows, table, ["k"])
    assert "ResolvedHint" not in planned._jdf.queryExecution().analyzed().toString()
    assert spark_rows(bounded) == spark_rows(planned)
    assert bounded.count() == 1000


def test_settled_table_beyond_the_threshold_is_shuffled(spark, cycle):
    solved = cycle.settled_solutions
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    wanted = spark_rows(stages.correct(cycle.vis, cycle.settled_predicted, solved))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        shuffled = stages.correct(cycle.vis, cycle.settled_predicted, solved)
        assert "SortMergeJoin" in plan(shuffled)
        assert spark_rows(shuffled) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_imaging_cycle_subtracts_and_flags(spark, data_dir):
    """No stage behind the totals is optimized away."""
    text = plan(QUERIES["imaging_cycle"](spark, data_dir))
    assert "limit#" in text and "gain#" in text and "residual_re#" in text


@pytest.mark.parametrize("name", ["per_partition_map", "fan_in_group", "solve", "stage_lineage"])
def test_no_python_workers(spark, data_dir, name):
    assert not re.search("Python|Arrow|Pandas", plan(QUERIES[name](spark, data_dir)))


def test_rows_without_key_are_stored_too(spark):
    rows = spark.range(100).selectExpr("id as v", "cast(if(id < 10, null, id % 4) as int) as k")
    path = stage_store.write_stage(rows, stage_store.new_stage_path(spark, "nulls"), ["k"], compact=True)
    assert spark_rows(stage_store.read_stage(spark, path, rows.schema)) == spark_rows(rows)


def test_a_second_whole_write_leaves_no_old_key(spark):
    path = stage_store.new_stage_path(spark, "whole")
    blocks = spark.range(6).selectExpr("id as v", "cast(id % 3 as int) as k")
    stage_store.write_stage(blocks, path, ["k"])
    stage_store.write_stage(blocks.where("k = 1"), path, ["k"])
    assert spark_rows(stage_store.read_stage(spark, path, blocks.schema)) == [(1, 1), (1, 4)]


def test_replacing_a_key_leaves_the_others(spark):
    path = stage_store.new_stage_path(spark, "replace")
    blocks = spark.range(6).selectExpr("id as v", "cast(id % 3 as int) as k")
    stage_store.write_stage(blocks, path, ["k"])
    stage_store.write_stage(blocks.where("k = 1").selectExpr("v + 100 as v", "k"), path, ["k"], replace=True)
    stored = stage_store.read_stage(spark, path, blocks.schema)
    assert spark_rows(stored) == [(0, 0), (0, 3), (1, 101), (1, 104), (2, 2), (2, 5)]


def test_settled_stage_is_stored_in_the_shared_folder(spark, cycle):
    files = cycle.settled_solutions.inputFiles()
    assert files and all(spark.conf.get("spark.checkpoint.dir") in f for f in files)
