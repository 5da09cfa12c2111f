"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fringeflow.operators.dataflow import group
from fringeflow.sources.stage_store import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component is its smallest node.

    A large star ties every larger neighbour of a node to the smallest node
    around it, a small star every smaller one and the node itself. Repeated,
    that makes each component a star around its smallest node, in rounds that grow with the logarithm of the nodes in
    practice. No neighbourhood is collected: minima combine before the
    shuffle, and each round is stored. Loops and edges with a null end are
    ignored; a graph without edges has no rows.
    """
    edges = edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b")
    edges = settle(edges.distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        around = group(both, ["a"], "min(b) as least_b").selectExpr("a", "least(a, least_b) as least")
        large = both.join(around, "a").where("b > a").selectExpr("b as a", "least as b").distinct()
        below = group(large, ["a"], "min(b) as least")
        small = large.join(below, "a").where("b > least").selectExpr("b as a", "least as b")
        edges = settle(small.unionByName(below.selectExpr("a", "least as b")).distinct(), "stars")
    centres = edges.selectExpr("b as node", "b as component").distinct()
    return edges.selectExpr("a as node", "b as component").unionByName(centres)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or only larger ones."""
    ends = edges.selectExpr("a as node", "1 as below", "0 as above").unionByName(edges.selectExpr("b as node", "0 as below", "1 as above"))
    sums = group(ends, ["node"], "sum(below) as below", "sum(above) as above")
    return sums.where("below > 1 or below = 1 and above > 0").isEmpty()
