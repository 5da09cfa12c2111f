"""The command line stores the results of a cycle."""

from __future__ import annotations

from compare import spark_rows

from fringeflow.__main__ import main
from fringeflow.queries import QUERIES


def test_cycle_is_stored(spark, data_dir, tmp_path, capsys):
    main([data_dir, str(tmp_path / "out")])
    for stage in ("cor_subvis_flag", "identify_component", "subimacom", "update_lsm"):
        stored = spark.read.parquet(str(tmp_path / "out" / stage))
        assert spark_rows(stored) == spark_rows(QUERIES[stage](spark, data_dir))
    assert "pharotpre_dft_sumvis" in capsys.readouterr().out
