"""Dataflow operators: key domains, fan-out, fan-in, mapping and accounting.

Keys, values and aggregates are SQL expressions, as in ``selectExpr``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.functions.digest import row_digest
from fringeflow.functions.numeric import idiv
from fringeflow.plans.joins import lookup
from fringeflow.sources.stage_store import settle, write_bucketed


def group(rows: DataFrame, keys: Sequence[str], *aggregates: str) -> DataFrame:
    """``groupBy(keys).agg(...)`` with aggregates as SQL text."""
    return rows.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Key domains


def index_grid(spark: SparkSession, dims: Mapping[str, int]) -> DataFrame:
    """Every key of a domain given by its dimension sizes.

    Keys are digits of a running number, so the domain is generated in
    parallel and needs no cross join.
    """
    total = stride = prod(dims.values())
    keys = []
    for name, size in dims.items():
        stride //= size
        keys.append(f"cast({idiv('id', stride)} % {size} as int) as {name}")
    return spark.range(total).selectExpr(*keys)


def dep_edges(domain: DataFrame, **sources: str) -> DataFrame:
    """Edge list: each key beside the source keys it reads."""
    return domain.selectExpr("*", *[f"cast({key} as int) as {name}" for name, key in sources.items()])


# Fan-out


def fan_out(blocks: DataFrame, dims: Mapping[str, int]) -> DataFrame:
    """Copy each block to every key of the new dimensions."""
    for name, size in dims.items():
        blocks = blocks.selectExpr("*", f"explode(sequence(0, {size - 1})) as {name}")
    return blocks


def refine(blocks: DataFrame, key: str, step: int, part: str = "part") -> DataFrame:
    """Split each coarse key ``k`` into ``step`` fine keys ``step * k + part``."""
    rest = [c for c in blocks.columns if c != key]
    parts = fan_out(blocks, {part: step})
    return parts.selectExpr(f"{key} * {step} + {part} as {key}", *rest, part)


# Fan-in


def fan_in_group(blocks: DataFrame, keys: Sequence[str], **aggregates: str) -> DataFrame:
    """Combine the blocks of each key, with a partial result per task."""
    return group(blocks, keys, *[f"{a} as {name}" for name, a in aggregates.items()])


def fan_in_union(sources: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Gather several sources by key, counting inputs and contributing sources.

    A source may carry ``n_in`` where a row already stands for several inputs.
    """
    tagged = [
        source.selectExpr(
            *keys,
            f"'{name}' as src",
            f"{value} as val",
            "n_in" if "n_in" in source.columns else "1L as n_in",
        )
        for name, source in sources.items()
    ]
    per_source = group(union_all(tagged), [*keys, "src"], "sum(n_in) as n_in", "sum(val) as val")
    return group(per_source, keys, "sum(n_in) as n_in", "count(*) as n_sources", "sum(val) as val")


def fan_in_zip(keys: Sequence[str], *blocks: DataFrame) -> DataFrame:
    """Bring blocks of equal key together, two sources or more."""
    return reduce(lambda left, right: left.join(right, list(keys)), blocks)


def fan_in_stored(keys: Sequence[str], blocks: Mapping[str, DataFrame], buckets: int) -> DataFrame:
    """``fan_in_zip`` of stages stored in buckets by key: each is dealt out once, when written, and never again.

    Whoever joins the stored stages on the key reads bucket beside bucket.
    Rows without a key meet nothing and are not stored.
    """
    stored = [write_bucketed(block, name, keys, buckets) for name, block in blocks.items()]
    return reduce(lambda left, right: left.hint("merge").join(right.hint("merge"), list(keys)), stored)


def cogroup_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides of every key; a key missing on one side keeps nulls there."""
    return left.join(right, list(keys), "full_outer")


def broadcast_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ship a table of a configured key domain to all tasks and look rows up in it."""
    return lookup(rows, table, keys, bounded=True)


def first_per_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """First row of each key under a total order.

    Combines map-side, so a key with very many rows costs one candidate per
    task. With one order column every buffer is a plain value and the rows
    are hashed, not sorted.
    """
    if len(order) == 1:
        return group(rows, keys, *[f"min_by({c}, {order[0]}) as {c}" for c in columns])
    ranks = [f"'rank{i}', {o}" for i, o in enumerate(order)]
    candidate = ", ".join([*ranks, *[f"'{c}', {c}" for c in columns]])
    firsts = group(rows, keys, f"min(named_struct({candidate})) as first")
    return firsts.selectExpr(*keys, *[f"first.{c} as {c}" for c in columns])


def collapse_global(rows: DataFrame, **aggregates: str) -> DataFrame:
    """One block from all rows, combined in parallel before the last step."""
    return fan_in_group(rows, [], **aggregates)


# Mapping


def per_row_map(rows: DataFrame, *keep: str, **columns: str) -> DataFrame:
    return rows.selectExpr(*keep, *[f"{c} as {name}" for name, c in columns.items()])


# Reuse and accounting


def stage_cache(stage: DataFrame, name: str) -> DataFrame:
    """Keep a stage that several consumers read, in the shared folder."""
    return settle(stage, name)


def stage_digest(stages: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows of each stage and an order-free digest of the named columns."""
    parts = [
        lineage_digest(stage, [], columns).selectExpr(f"'{name}' as stage", "n_in as n_rows", "digest")
        for name, (stage, columns) in stages.items()
    ]
    return union_all(parts)


def stage_count(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each stage; an empty stage counts 0."""
    counts = [
        group(stage, [], "count(*) as n_rows").selectExpr(f"'{name}' as stage", "n_rows")
        for name, stage in stages.items()
    ]
    return union_all(counts)


def lineage_digest(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free digest per key. Equal rows cancel in pairs, so ``n_in`` stays beside it."""
    return group(rows, keys, "count(*) as n_in", f"bit_xor({row_digest(*columns)}) as digest")


def input_volume(rows: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Inputs and bytes read per key."""
    return group(rows, keys, "count(*) as n_in", f"sum(octet_length({payload})) as input_bytes")


def stage_report(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Blocks and inputs per stage, and in total in the row without a stage."""
    blocks = [stage.selectExpr(f"'{name}' as stage", "n_in") for name, stage in stages.items()]
    totals = group(union_all(blocks), ["stage"], "count(*) as n_rows", "sum(n_in) as n_in")
    return report_total(totals)


def report_total(stages: DataFrame) -> DataFrame:
    """``stage, n_tasks, n_in`` of ``stages(stage, n_rows, n_in)``, and their total in the row without a stage."""
    totals = stages.selectExpr("stage", "n_rows as n_tasks", "n_in")
    return totals.rollup("stage").agg(F.expr("sum(n_tasks) as n_tasks"), F.expr("sum(n_in) as n_in"))
