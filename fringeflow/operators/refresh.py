"""Bring a stored stage up to date: only keys whose inputs changed are computed again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.operators.dataflow import group
from fringeflow.sources import stage_store
from fringeflow.sources.stage_store import settle


def _same_key(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def refresh_stage(
    inputs: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Store ``build(inputs)`` by ``keys`` under ``path``, or refresh what is there; gives the refreshed keys.

    Beside the stage lies a manifest with the number and digest of each key's
    input rows, over ``columns``. Keys that are new or differ from it are
    built from their own inputs and replaced, keys without inputs any more
    are removed, all others are left alone. ``build`` must work key by key,
    with ``keys`` among its columns. Result: ``keys`` and ``state``: new,
    changed or removed.

    The manifest is written last: a refresh that is cut off is repeated by
    the next one.
    """
    spark = inputs.sparkSession
    manifest = f"{path}_manifest"
    # A sum, not an exclusive or: two equal rows that both become other equal ones must show.
    digest = f"sum(cast(xxhash64({', '.join(columns)}) as decimal(20,0))) as digest"
    now = settle(group(inputs, keys, "count(*) as n_in", digest), "digests")
    known = stage_store.exists(spark, manifest)
    before = stage_store.read_stage(spark, manifest, now.schema) if known else now.limit(0)
    theirs = before.select(*[F.col(c).alias(f"old_{c}") for c in before.columns])
    pairs = now.join(theirs, reduce(lambda a, b: a & b, [now[k].eqNullSafe(theirs[f"old_{k}"]) for k in keys]), "full_outer")
    state = (
        "case when old_n_in is null then 'new' when n_in is null then 'removed'"
        " when n_in <> old_n_in or digest <> old_digest then 'changed' end as state"
    )
    either = [f"if(n_in is null, old_{k}, {k}) as {k}" for k in keys]
    changes = settle(pairs.selectExpr(*either, state).where("state is not null"), "changes")

    wanted = changes.where("state <> 'removed'")
    if not wanted.isEmpty():
        rows = inputs.join(wanted, _same_key(inputs, wanted, keys), "left_semi")
        stage_store.write_stage(build(rows), path, keys, replace=True)
    # As many folders as the key domain has keys, at most.
    for row in changes.where("state = 'removed'").select(*keys).toLocalIterator():
        names = [f"{k}={'__HIVE_DEFAULT_PARTITION__' if row[k] is None else row[k]}" for k in keys]
        stage_store.remove_stage(spark, "/".join([path, *names]))
    stage_store.write_stage(now, manifest)
    return changes
