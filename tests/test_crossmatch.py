"""The merged catalogue against plain Python."""

from __future__ import annotations

import random

from compare import spark_rows

from fringeflow import ImagingConfig, ImagingCycle
from fringeflow.operators import crossmatch

LSM = "comp_id bigint, beam int, facet int, flux bigint, u int, w int"
SOURCES = "island bigint, facet int, u int, w int, flux bigint"


def plain(lsm, sources, c: ImagingConfig):
    pairs = []
    for s, f, u, w, _ in sources:
        for comp, _, g, _, a, b in lsm:
            if comp is not None and f == g:
                du, dw = (min((p - q) % c.cells, (q - p) % c.cells) for p, q in ((a, u), (b, w)))
                if du**2 + dw**2 <= c.match_radius**2:
                    pairs.append((du**2 + dw**2, s, comp))
    of_source, of_comp = {}, {}
    for d2, s, comp in pairs:
        of_source[s] = min(of_source.get(s, (99, 0)), (d2, comp))
        of_comp[comp] = min(of_comp.get(comp, (99, 0)), (d2, s))
    matched = {comp: s for s, (_, comp) in of_source.items() if of_comp[comp][1] == s}
    by_name = {s[0]: s for s in sources}
    out = []
    for comp, beam, f, flux, u, w in lsm:
        if comp in matched:
            _, _, u, w, more = by_name[matched[comp]]
            flux = (flux or 0) + more
        out.append((comp, beam, f, flux, u, w))
    base = min([0, *(x[0] for x in lsm if x[0] is not None)])
    return out + [(base - 1 - s, 0, f, flux, u, w) for s, f, u, w, flux in sources if s not in matched.values()]


def tables(seed=1):
    rnd = random.Random(seed)
    lsm = [(i - 5, 0, rnd.randrange(3), rnd.choice([None, 100 + i]), rnd.randrange(8), rnd.randrange(8)) for i in range(60)]
    lsm += [(1000 + i, 0, 1, 7, 0, 0) for i in range(50)] + [(None, None, 2, 5, None, None), (None, None, 2, 5, 1, 1)]
    places = rnd.sample([(f, u, w) for f in range(4) for u in range(8) for w in range(8)], 70)
    return lsm, [(i * 3, *p, 10_000 + i) for i, p in enumerate(places)]


def test_merge_equals_plain_python(spark):
    for radius in (0, 1, 2):
        config = ImagingConfig(facets=4, cells=8, match_radius=radius)
        lsm, sources = tables()
        merged = crossmatch.merge_catalogue(spark.createDataFrame(lsm, LSM), spark.createDataFrame(sources, SOURCES), config)
        key = lambda r: tuple((x is not None, x or 0) for x in r)
        got = sorted((tuple(r[c] for c in ("comp_id", "beam", "facet", "flux", "u", "w")) for r in merged.collect()), key=key)
        assert got == sorted(plain(lsm, sources, config), key=key)
        assert len(lsm) < len(got) < len(lsm) + len(sources)


def test_the_same_sources_again_add_nothing(spark):
    config = ImagingConfig(facets=4, cells=8)
    lsm, sources = tables(2)
    found = spark.createDataFrame(sources, SOURCES)
    once = crossmatch.merge_catalogue(spark.createDataFrame(lsm, LSM), found, config)
    once = spark.createDataFrame(once.collect(), LSM)
    twice = crossmatch.merge_catalogue(once, found, config)
    ids = lambda frame: sorted((r.comp_id is not None, r.comp_id or 0, r.u, r.w) for r in frame.where("u is not null").collect())
    assert ids(once) == ids(twice) and once.count() == twice.count() > len(lsm)


def test_no_sources_and_no_catalogue(spark):
    config = ImagingConfig()
    lsm, sources = tables(3)
    frames = lambda a, b: (spark.createDataFrame(a, LSM), spark.createDataFrame(b, SOURCES))
    kept = crossmatch.merge_catalogue(*frames(lsm, []), config)
    assert spark_rows(kept) == spark_rows(spark.createDataFrame(lsm, LSM))
    added = crossmatch.merge_catalogue(*frames([], sources), config).collect()
    assert {r.comp_id for r in added} == {-1 - s[0] for s in sources}


def test_catalogue_rows_are_not_shuffled(spark, data_dir):
    cycle = ImagingCycle(spark, data_dir)
    pairs = crossmatch.near_components(cycle.lsm, cycle.sources, cycle.config)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
