"""Major loops, stages measured while written, and stages joined where they are stored."""

from __future__ import annotations

import pytest
from compare import spark_rows

from fringeflow import ImagingCycle
from fringeflow.operators import dataflow, kernels
from fringeflow.plans.major import run_major_loops
from fringeflow.queries import QUERIES
from fringeflow.sources import stage_store


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_loops_pass_the_catalogue_on_and_stop(spark, data_dir):
    loops = run_major_loops(spark, data_dir, most=3, stop_percent=100)
    rows = loops.report.orderBy("major_loop").collect()
    # A loop is compared with the one before, so two are the least.
    assert [r.major_loop for r in rows] == [0, 1]
    assert rows[0].n_after == rows[1].n_before and rows[1].n_after == loops.catalogue.count()
    text = plan(loops.catalogue)
    assert text.count("FileScan parquet") == 1 and "Join" not in text


def test_loops_run_to_their_number(spark, data_dir):
    assert run_major_loops(spark, data_dir, most=1).report.count() == 1


def test_stored_stages_are_measured_as_they_are_written(spark, data_dir):
    cycle = ImagingCycle(spark, data_dir)
    rows = {r.stage: (r.n_rows, r.n_in) for r in cycle.store("rep", "deg", "predicted", "solutions").collect()}
    plain = ImagingCycle(spark, data_dir)
    assert rows["reppre_ifft"] == (980, plain.rep.selectExpr("sum(n_in)").first()[0])
    assert rows["degkerupd_deg"] == (3920, 3920) and rows["pharotpre_dft_sumvis"][0] == 20
    assert rows["solve"] == (plain.solutions.count(), plain.vis.count())
    # The report is made of numbers at hand, and later stages read what is stored.
    report = QUERIES["stage_report"](spark, data_dir)
    assert "Scan parquet" not in plan(report) and "FileScan" not in plan(report)
    assert cycle.settled_predicted.inputFiles() == cycle.predicted.inputFiles()
    assert spark_rows(cycle.solutions) == spark_rows(plain.solutions)


def test_empty_stage_is_measured(spark):
    none = spark.range(0).selectExpr("id", "1L as n_in")
    path = stage_store.new_stage_path(spark, "none")
    assert stage_store.write_measured(none, path, n_rows="count(*)", n="coalesce(sum(n_in), 0L)") == {"n_rows": 0, "n": 0}


def test_stored_fan_in_needs_no_exchange(spark, data_dir):
    frame = QUERIES["fan_in_stored"](spark, data_dir)
    assert "Exchange" not in plan(frame) and plan(frame).count("SortMergeJoin") == 2
    assert frame.count() == 1000
    stage_store.drop_bucketed(spark)
    assert not stage_store.BUCKETED


@pytest.mark.parametrize("buckets", [1, 5])
def test_stored_fan_in_equals_the_join(spark, buckets):
    left = spark.range(200).selectExpr("id % 60 as k", "id as a").unionByName(spark.sql("select null as k, 7L as a"))
    right = spark.range(50).selectExpr("id as k", "id * 3 as b").unionByName(spark.sql("select null as k, 8L as b"))
    third = spark.range(40).selectExpr("id * 2 as k", "id as c")
    got = dataflow.fan_in_stored(["k"], {"left": left, "right": right, "third": third}, buckets)
    assert spark_rows(got) == spark_rows(dataflow.fan_in_zip(["k"], left, right, third))
    stage_store.drop_bucketed(spark)


def test_prediction_of_one_source_is_its_wave(spark, data_dir):
    """A lone component at the origin of facet 0 is equally strong in all cells of its image."""
    cycle = ImagingCycle(spark, data_dir)
    flux = 256 * 10**6
    lsm = spark.sql(f"select 1L as comp_id, 0 as beam, 0 as facet, {flux}L as flux, 0 as u, 0 as w")
    cells = kernels.model_cells(lsm, cycle.config).collect()
    assert len(cells) == 4 * 256 and {(r.re, r.im) for r in cells} == {(10**6, 0)}
    seen = kernels.predict_degridded(cycle.vis, kernels.model_cells(lsm, cycle.config), cycle.config).collect()
    assert len(seen) == 1000 and {(r.model_re, r.model_im) for r in seen if r.facet == 0} == {(10**6, 0)}
    assert all(r.model_re is None for r in seen if r.facet != 0)


def test_residuals_of_measurements_that_equal_their_prediction_vanish(spark, data_dir):
    cycle = ImagingCycle(spark, data_dir)
    seen = cycle.degridded.selectExpr("event_id", "frequency", "time", "facet", "polarisation", "model_re * 3 as re", "model_im * 3 as im", "model_re", "model_im")
    left = kernels.subtract_degridded(seen, kernels.solve_degridded(seen))
    assert left.where("abs(residual_re) > 0 or abs(residual_im) > 0").isEmpty() and left.count() == 1000
