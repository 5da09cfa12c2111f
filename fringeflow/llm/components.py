"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.sources.stage_store import settle

Batches = Iterator[pa.RecordBatch]


def joined_nodes(batches: Batches) -> Batches:
    """``node, moved`` of all nodes of the edges: the smallest one each is connected with, by union-find."""
    parent: dict = {}

    def top(node):
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[above]
        return node

    kind = None
    for batch in batches:
        kind = batch.column("src").type
        for ends in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist()):
            low, high = sorted(map(top, ends))
            parent[high] = low
    if parent:
        columns = [pa.array(list(parent), kind), pa.array([top(node) for node in list(parent)], kind)]
        yield pa.RecordBatch.from_arrays(columns, ["node", "moved"])


def connected_components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; a component is named by its smallest node.

    Each round gives all nodes a fresh pseudo-random order, points every node
    to its first neighbour if that comes before itself, follows pointers two
    steps and contracts the edges. About half of the nodes go per round
    whatever the shape of the graph, so rounds grow with the logarithm of its
    size. A hub only meets a minimum that is combined before the shuffle and
    joins that adaptive execution can split. Every round is written to the
    shared folder, which cuts the lineage in storage that outlives executors.
    Once no more than ``at_once`` edges are left, counted, one task joins
    them in place of further rounds.

    Edges with a null end and loops are ignored; repeated edges count once. A
    graph without edges gives no rows.
    """
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    edges = settle(edges, "edges")
    moves = []
    while not edges.isEmpty():
        if at_once and edges.count() <= at_once:
            kind = edges.schema["src"].dataType.simpleString()
            moved = edges.coalesce(1).mapInArrow(joined_nodes, f"node {kind}, moved {kind}")
            moves.append(settle(moved, "moved"))
            break
        salt = len(moves)
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        order = f"struct(xxhash64({{0}}, {salt}) as h, {{0}} as node)"
        first = both.groupBy("src").agg(F.expr(f"min({order.format('dst')})").alias("first"))
        parents = settle(
            first.selectExpr("src as node", f"least(first, {order.format('src')}).node as parent"), "parents"
        )
        above = parents.selectExpr("node as parent", "parent as above")
        moved = settle(parents.join(above, "parent").selectExpr("node", "above as moved"), "moved")
        moves.append(moved)
        left, right = (moved.selectExpr(f"node as {end}", f"moved as new_{end}") for end in ("src", "dst"))
        edges = edges.join(left, "src").join(right, "dst").where("new_src <> new_dst")
        edges = settle(edges.selectExpr("new_src as src", "new_dst as dst").distinct(), "edges")
    if not moves:
        return edges.selectExpr("src as node", "src as component")
    place = moves[0]
    for moved in moves[1:]:
        step = moved.selectExpr("node as moved", "moved as next")
        place = place.join(step, "moved", "left").selectExpr("node", "coalesce(next, moved) as moved")
    place = settle(place, "place")
    named = place.groupBy("moved").agg(F.min("node").alias("component"))
    return place.join(named, "moved").select("node", "component")
