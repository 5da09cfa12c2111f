"""Cardinalities and invariants of the cycle."""

from __future__ import annotations

import pytest
from compare import spark_rows

from fringeflow import NARROW_SNAPSHOT, WIDE_FACETS, ImagingConfig, ImagingCycle
from fringeflow.operators import crossmatch, dataflow, kernels, stages
from fringeflow.queries import QUERIES


@pytest.fixture(scope="module")
def cycle(spark, data_dir):
    return ImagingCycle(spark, data_dir, store_cells=True)


def total(frame, expression):
    return frame.selectExpr(f"{expression} as v").first()["v"]


def test_stage_cardinalities(spark, data_dir):
    rows = {r["stage"]: r["n_rows"] for r in QUERIES["stage_lineage"](spark, data_dir).collect()}
    # Blocks per stage, where they do not depend on the tables.
    assert rows["reppre_ifft"] == 980
    assert rows["degkerupd_deg"] == 3920
    assert rows["pharotpre_dft_sumvis"] == 20
    assert rows["solve"] == 8
    assert rows["cor_subvis_flag"] == rows["visibility_buffer"]
    assert rows["telescope_data"] == 1
    assert rows["local_sky_model"] <= rows["update_lsm"] <= rows["local_sky_model"] + rows["source_find"]


def test_prediction_reads_all_images_and_the_extracted_catalogue(cycle):
    assert {r["n_in"] for r in cycle.predicted.collect()} == {197}


def test_wide_domain_cardinalities(spark, data_dir):
    cycle = ImagingCycle(spark, data_dir, WIDE_FACETS)
    assert cycle.rep.count() == 1620
    assert {r["n_in"] for r in cycle.predicted.collect()} == {325}


def test_every_measurement_is_in_the_grid_once(cycle):
    assert total(cycle.cells, "sum(n_in)") == cycle.vis.count()
    assert total(cycle.cells, "sum(n_flagged)") == cycle.flagged.where("flag").count()


def test_flags_antennas_and_imaginary_parts_reach_the_image(spark, cycle):
    """Changing one flag, one antenna or one imaginary part changes the image of a facet."""
    config = cycle.config

    def image(flagged, telescope_block):
        return spark_rows(kernels.facet_images(stages.grid(flagged, telescope_block, config), config))

    flagged, block = cycle.settle(cycle.flagged, "flagged"), cycle.telescope_block
    # Facet 0 rotates no phase; any other mixes both parts.
    some = flagged.where("not flag and residual_re <> 0").first()["event_id"]
    here = f"event_id = {some}"
    plain = image(flagged, block)
    columns = [c for c in flagged.columns if c != "flag"]
    assert image(flagged.selectExpr(*columns, f"flag or {here} as flag"), block) != plain
    rest = [c for c in flagged.columns if c != "residual_im"]
    moved = f"residual_im + if({here}, 1000000000, 0) as residual_im"
    assert image(flagged.selectExpr(*rest, moved), block) != plain
    louder = cycle.telescope.selectExpr("antenna_id", "beam", "gain + if(antenna_id = 1, 100000000, 0) as gain")
    assert image(flagged, stages.telescope_data(louder)) != plain


def test_inverse_transform_restores_the_grid(cycle):
    cells = cycle.cells.select("facet", "polarisation", "u", "w", "re", "im")
    restored = kernels.idft(kernels.dft(cells, cycle.config), cycle.config).where("re != 0 or im != 0")
    joined = restored.withColumnsRenamed({"re": "new_re", "im": "new_im"}).join(
        cells.where("re != 0 or im != 0"), ["facet", "polarisation", "u", "w"], "full_outer"
    )
    # Factors are rounded to 1e-6 and passes to whole units.
    off = "max(greatest(abs(coalesce(new_re, 0) - coalesce(re, 0)), abs(coalesce(new_im, 0) - coalesce(im, 0))))"
    largest = total(cells, "max(abs(re) + abs(im))")
    assert total(joined, off) <= 2 + largest * 1e-5


def test_closing_a_cycle_removes_what_it_settled(spark, data_dir):
    cycle = ImagingCycle(spark, data_dir)
    assert cycle.settled_predicted.count() == 20
    cycle.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(cycle.settled_predicted.inputFiles()[0]).count()


def test_transform_is_exact_for_large_cells(spark):
    config = ImagingConfig(facets=1, polarisations=1)
    value = 10**13 + 7
    cells = spark.sql(f"select 0 as facet, 0 as polarisation, 3 as u, 5 as w, {value}L as re, 0L as im")
    restored = kernels.idft(kernels.dft(cells, config), config).where("u = 3 and w = 5")
    got = restored.first()["re"]
    # Factors are rounded to 1e-6, so a lone cell comes back within that share.
    assert abs(got - value) <= value * 2e-6
    exact = kernels.dft_rows(cells, config).where("k = 0").first()["re"]
    assert exact == value * 1000


def test_updated_catalogue_starts_another_cycle(spark, data_dir, cycle):
    updated = cycle.updated_lsm
    assert updated.columns == cycle.lsm.columns
    size = updated.count()
    assert cycle.lsm.count() < size < cycle.lsm.count() + cycle.sources.count()
    assert updated.select("comp_id").distinct().count() == size
    again = crossmatch.merge_catalogue(updated, cycle.sources, cycle.config)
    assert again.count() == size
    second = ImagingCycle(spark, data_dir, catalogue=cycle.settle(updated, "catalogue"))
    assert second.predicted.count() == 20
    assert second.updated_lsm.select("comp_id").distinct().count() == second.updated_lsm.count()


def test_digest_ignores_order_and_partitions(cycle):
    digest = dataflow.lineage_digest(cycle.vis, ["frequency"], ["event_id", "re"])
    moved = dataflow.lineage_digest(cycle.vis.repartition(5, "re"), ["frequency"], ["event_id", "re"])
    assert spark_rows(digest) == spark_rows(moved)


def test_digest_counts_what_cancels(spark):
    rows = spark.sql("select 1 as k, explode(array('a', 'a')) as v")
    assert spark_rows(dataflow.lineage_digest(rows, ["k"], ["v"])) == [(0, 1, 2)]


def test_last_coarse_channel_keeps_its_own_value(spark, cycle):
    silent = cycle.telescope_block.selectExpr("beam", "n_in", "0L as gain")
    deg = stages.degkerupd_deg(cycle.rep, silent, cycle.config)
    for part in ("model_re", "model_im"):
        last = cycle.rep.where("frequency = 4").select("facet", "polarisation", part)
        for wanted in ("max", "min"):
            fine = deg.where("frequency >= 16").groupBy("facet", "polarisation").agg({part: wanted})
            assert spark_rows(last.toDF("f", "p", "v")) == spark_rows(fine.toDF("f", "p", "v"))


def test_kernel_wraps_at_the_edge(spark):
    config = ImagingConfig(facets=1, polarisations=1)
    cells = spark.sql("select 0 as facet, 0 as polarisation, 0 as u, 15 as w, 1L as re, 2L as im, 1L as n_in")
    spread = {(r["u"], r["w"]): r["re"] for r in kernels.convolve_grid(cells, config).collect()}
    assert spread == {
        (u, w): a * b for u, a in ((15, 1), (0, 2), (1, 1)) for w, b in ((14, 1), (15, 2), (0, 1))
    }


def test_kernels_follow_plane_and_place(spark):
    """A kernel leans to the side of the cell its measurement lies on, and widens with its plane."""
    config = ImagingConfig(cells=8)
    table = {(r.plane, r.su, r.sw, r.du, r.dw): r.weight for r in kernels.kernel_table(spark, config).collect()}
    assert len(table) == 4 * 4 * 9
    # Places lie a quarter cell off the middle; distances to the cells around are 3, 1 and 5 quarters.
    assert [table[0, 0, 0, d, 1] for d in range(3)] == [(4 - 3) * 3, 3 * 3, 0]
    assert [table[0, 1, 0, d, 1] for d in range(3)] == [0, 3 * 3, (4 - 3) * 3]
    assert [table[2, 0, 0, d, 1] for d in range(3)] == [(6 - 3) * 5, 5 * 5, (6 - 5) * 5]
    schema = "event_id bigint, frequency int, time int, facet int, polarisation int, residual_re bigint, residual_im bigint, flag boolean"
    rows = [(0, 0, 2, 0, 0, 10, 4, False), (64, 0, 0, 0, 0, 1, 0, False), (0, 0, 2, 0, 0, 999, 9, True), (None, 0, 0, 0, 0, 5, 5, False)]
    got = {(r.u, r.w): (r.re, r.im, r.n_in) for r in kernels.grid_planes(spark.createDataFrame(rows, schema), config).collect()}
    assert got[0, 0] == (10 * 25 + 9, 4 * 25, 3) and got[1, 0] == (10 * 5 + 3, 4 * 5, 3) and got[7, 7] == (10 * 9, 4 * 9, 2)


def test_tied_peaks_take_the_first_cell(spark):
    cells = spark.sql(
        "select 0 as facet, p as polarisation, u, 2 as w, c as cell from values"
        " (1, 0, 9L), (0, 3, -9L), (0, 1, 9L), (0, 0, null) as t(p, u, c)"
    )
    assert stages.identify_component(cells).collect()[0].asDict() == {
        "facet": 0, "polarisation": 0, "u": 1, "w": 2, "cell": 9,
    }


def test_round_trip_of_stored_stage(spark, data_dir, cycle):
    stored = QUERIES["stored_by_channel"](spark, data_dir)
    direct = dataflow.group(cycle.vis, ["time", "frequency"], "sum(re) as re", "sum(im) as im", "count(*) as n_in")
    assert spark_rows(stored) == spark_rows(direct)


def test_config_rejects_uneven_domains():
    with pytest.raises(ValueError):
        ImagingConfig(channels=21)
    with pytest.raises(ValueError):
        ImagingConfig(slots=7_001)
    assert WIDE_FACETS.max_images == 324 and NARROW_SNAPSHOT.slot_seconds == 324_000
