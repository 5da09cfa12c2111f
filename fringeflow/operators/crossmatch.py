"""Merge found sources into the catalogue by their position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.config import ImagingConfig
from fringeflow.functions.numeric import key_mod
from fringeflow.operators.dataflow import fan_out, group, union_all
from fringeflow.plans.joins import lookup

PLACE = ["facet", "u", "w"]


def near_components(lsm: DataFrame, sources: DataFrame, config: ImagingConfig) -> DataFrame:
    """Pairs ``source, comp_id, d2`` of a source and a component at most ``match_radius`` cells apart.

    Each source looks into the cells around its own; images wrap around at
    their edges. Only the sources are copied: with one of them in a cell at
    most, a component meets no more of them than there are such cells, however
    many components lie in one.
    """
    n, r = config.cells, config.match_radius
    copies = fan_out(sources.selectExpr("island as source", *PLACE), {"du": 2 * r + 1, "dw": 2 * r + 1})
    around = copies.selectExpr(
        "source",
        "facet",
        f"{key_mod(f'u + du - {r}', n)} as u",
        f"{key_mod(f'w + dw - {r}', n)} as w",
        f"(du - {r}) * (du - {r}) + (dw - {r}) * (dw - {r}) as d2",
    ).where(f"d2 <= {r * r}")
    placed = lsm.where("comp_id is not null").select("comp_id", *PLACE)
    return lookup(placed, around, PLACE, bounded=True, how="inner").select("source", "comp_id", "d2")


def mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Pairs ``source, comp_id`` of which each is the other's nearest; of equally near ones the smaller id counts.

    So a source is in one pair at most, and so is a component.
    """
    of_source = group(pairs, ["source"], "min(struct(d2, comp_id)).comp_id as comp_id")
    of_component = group(pairs, ["comp_id"], "min(struct(d2, source)).source as source")
    return of_source.join(of_component, ["source", "comp_id"])


def merge_catalogue(lsm: DataFrame, sources: DataFrame, config: ImagingConfig) -> DataFrame:
    """The catalogue with ``sources(island, facet, u, w, flux)``, with the columns of the catalogue.

    A source and a component that are each other's nearest become one: the
    source's flux is added to the component, which moves to its place. Other
    sources are added under ids below all others. The same sources again find
    their components in place, so they add none.
    """
    matches = mutual_nearest(near_components(lsm, sources, config))
    found = sources.selectExpr("island as source", *[f"{c} as new_{c}" for c in ("facet", "u", "w", "flux")])
    matched = lookup(found, matches, ["source"], bounded=True)
    changes = matched.where("comp_id is not null").select("comp_id", "new_flux", "new_u", "new_w")
    kept = lookup(lsm, changes, ["comp_id"], bounded=True).selectExpr(
        "comp_id",
        "beam",
        "facet",
        "cast(if(new_flux is null, flux, coalesce(flux, 0) + new_flux) as bigint) as flux",
        "coalesce(new_u, u) as u",
        "coalesce(new_w, w) as w",
    )
    least = lsm.selectExpr("least(min(comp_id), 0)").scalar()
    added = matched.where("comp_id is null").withColumn("base", F.coalesce(least, F.lit(0)))
    added = added.selectExpr(
        "base - 1 - source as comp_id", "0 as beam", "new_facet as facet", "new_flux as flux", "new_u as u", "new_w as w"
    )
    return union_all([kept, added])
