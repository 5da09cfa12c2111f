"""Refreshed stages: what is built, replaced, removed and left alone."""

from __future__ import annotations

from compare import spark_rows

from fringeflow.operators.dataflow import group
from fringeflow.operators.refresh import refresh_stage
from fringeflow.sources import stage_store

SCHEMA = "k int, v bigint"


def test_only_changed_keys_are_built(spark):
    path = stage_store.new_stage_path(spark, "refreshed")
    built = []

    def build(rows):
        built.append(sorted({r.k for r in rows.select("k").collect()}, key=str))
        return group(rows, ["k"], "sum(v) as v", "count(*) as n")

    def run(rows):
        frame = spark.createDataFrame(rows, SCHEMA)
        states = {r.k: r.state for r in refresh_stage(frame, path, ["k"], ["v"], build).collect()}
        stored = stage_store.read_stage(spark, path, build(frame).schema)
        built.pop()
        assert spark_rows(stored) == spark_rows(group(frame, ["k"], "sum(v) as v", "count(*) as n"))
        return states

    first = [(1, 5), (1, 6), (2, 7), (None, 8)]
    assert run(first) == {1: "new", 2: "new", None: "new"}
    # Order does not matter; nothing is built.
    assert run(first[::-1]) == {} and len(built) == 1
    # Two equal rows more cancel in the digest, but not in the count.
    assert run([*first, (2, 9), (2, 9)]) == {2: "changed"} and built[-1] == [2]
    assert run([(1, 5), (1, 6), (3, 1), (None, 8)]) == {2: "removed", 3: "new"} and built[-1] == [3]
    assert run([(1, 5), (1, 6), (3, 1)]) == {None: "removed"}
    assert run([(1, None), (3, 1)]) == {1: "changed"}
    assert run([(4, 5), (4, 5)]) == {1: "removed", 3: "removed", 4: "new"}
    # Rows that are equal in pairs, before and after.
    assert run([(4, 6), (4, 6)]) == {4: "changed"} and built[-1] == [4]


def test_no_inputs(spark):
    path = stage_store.new_stage_path(spark, "none")
    changes = refresh_stage(spark.createDataFrame([], SCHEMA), path, ["k"], ["v"], lambda rows: rows)
    assert changes.collect() == []
