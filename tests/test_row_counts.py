"""Row counts of the queries on the generated tables, as the survey measured them."""

from __future__ import annotations

from pathlib import Path

import pytest

from fringeflow.queries import QUERIES

SCALES = ("sf0.001", "sf0.01", "sf0.1")

# Rows at sf0.001, sf0.01 and sf0.1.
ROWS = {
    "visibility_buffer": (1000, 10_000, 100_000),
    "timeslots": (1000, 10_000, 100_000),
    "subtract_visibility": (1000, 10_000, 100_000),
    "cor_subvis_flag": (1000, 10_000, 100_000),
    "phase_rotation": (1000, 10_000, 100_000),
    "degrid": (1000, 10_000, 100_000),
    "local_sky_model": (200, 2000, 20_000),
    "telescope_management": (10, 100, 1000),
    "index_grid": (980, 980, 980),
    "reppre_ifft": (980, 980, 980),
    "dep_edges": (3920, 3920, 3920),
    "degkerupd_deg": (3920, 3920, 3920),
    "pharotpre_dft_sumvis": (20, 20, 20),
    "sum_visibilities": (20, 20, 20),
    "fan_in_union": (20, 20, 20),
    "lineage_digest": (20, 20, 20),
    "input_volume": (20, 20, 20),
    "first_per_key": (20, 20, 20),
    "solve": (8, 8, 8),
    "extract_lsm": (1, 1, 1),
    "telescope_data": (1, 1, 1),
    "source_find": (1, 1, 1),
    "grid": (990, 9096, 42_209),
    "reprojection": (990, 9096, 42_209),
    "grid_convolved": (6792, 40_987, 50_176),
    "grikerupd_pharot_grid_fft_rep": (15_360, 50_176, 50_176),
    "missing_keys": (9, 9, 9),
    "next_cycle": (20, 20, 20),
    "sum_facets": (60, 196, 196),
    "subimacom": (60, 196, 196),
    "identify_component": (15, 49, 49),
    "find_sources": (15, 49, 49),
    "source_islands": (121, 406, 94),
    "minor_cycle_components": (857, 2565, 3160),
    "minor_cycle_residuals": (15_360, 50_176, 50_176),
    "point_spread": (15_360, 50_176, 50_176),
    "solve_antennas": (128, 128, 128),
    "correct_antennas": (1000, 10_000, 100_000),
    "update_lsm": (308, 2190, 20_000),
    "dft_rows": (9568, 48_000, 50_176),
    "dft": (15_360, 50_176, 50_176),
    "idft_columns": (15_360, 50_176, 50_176),
    "idft": (15_360, 50_176, 50_176),
    "stage_report": (5, 5, 5),
}
FLAGGED = (80, 876, 14_372)


@pytest.fixture(scope="module")
def scale(data_dir):
    name = Path(data_dir).name
    if name not in SCALES:
        pytest.skip("counts are known for the generated tables only")
    return SCALES.index(name)


@pytest.mark.parametrize("name", list(ROWS))
def test_row_count(spark, data_dir, scale, name):
    assert QUERIES[name](spark, data_dir).count() == ROWS[name][scale]


def test_flagged_measurements(spark, data_dir, scale):
    assert QUERIES["cor_subvis_flag"](spark, data_dir).where("flag").count() == FLAGGED[scale]
