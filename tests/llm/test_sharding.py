from __future__ import annotations

import zlib
from collections import Counter

from fringeflow.llm.sharding import Leaf, shard_documents, topology, tree_shard


def test_every_row_gets_a_slot(make_docs, awkward):
    rows = awkward + [(77, "same")] * 300
    got = shard_documents(make_docs(rows, 7), topology(8), topology(9)).collect()
    size = lambda t: 1 + len((t or "").encode())
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t in rows)
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert {(r.grown_shard in (r.shard, 8)) for r in got} == {True}
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in {i for i, _ in rows})


def test_empty_table(make_docs):
    assert shard_documents(make_docs([]), topology(8), topology(9)).collect() == []


def test_weights_decide_shares_and_confine_movement(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) as id")
    old = [Leaf("a", "x", 0, 1), Leaf("a", "x", 1, 3), Leaf("a", "y", 2, 2), Leaf("b", "z", 3, 2)]
    new = [Leaf("a", "x", 0, 1), Leaf("a", "x", 1, 3), Leaf("a", "y", 2, 2), Leaf("b", "z", 3, 2), Leaf("b", "z", 4, 0.5)]
    moved = tree_shard(tree_shard(rows, "id", old, "old"), "id", new, "new").groupBy("old", "new").count().collect()
    shares = Counter()
    for r in moved:
        shares[r.old] += r["count"]
    assert all(abs(shares[x.shard] / 20_000 - x.weight / 8) < 0.02 for x in old)
    # Region b grew: rows only move into it, none within or out of region a.
    assert {(r.old, r.new) for r in moved if r.old != r.new} <= {(0, 3), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_further_shards_only_take_rows(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) as id")
    for n in (8, 9, 10):
        both = tree_shard(tree_shard(rows, "id", topology(n), "old"), "id", topology(n + 1), "new")
        assert both.where(f"old <> new and new <> {n}").isEmpty()
