"""Place rows in shards by weighted draws down a tree of regions, racks and shards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.sources.stage_store import settle

# Rows of a shard are numbered within 16**BUCKET_DIGITS ranges of a hash, so
# no task numbers a whole shard.
BUCKET_DIGITS = 4


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = 8) -> tuple[Leaf, ...]:
    """``base`` shards in regions of four and racks of two; each further shard opens a region.

    A new region changes no weight inside the others, so all rows that move
    go into the new shard.
    """
    leaves = [Leaf(f"r{i // 4}", f"k{i % 4 // 2}", i) for i in range(min(shards, base))]
    return (*leaves, *(Leaf(f"x{i}", "k0", i) for i in range(base, shards)))


def _draw(key: Column, level: str, name: str, weight: float) -> Column:
    """Exponential waiting time of a child; the child with the least wins in proportion to its weight."""
    digest = F.md5(F.concat(key, F.lit(f"/{level}/{name}")))
    unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(unit) / F.lit(float(weight))


def _pick(key: Column, level: str, weights: dict[str, float]) -> Column:
    draws = [F.struct(_draw(key, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in weights.items()]
    return F.array_min(F.array(*draws))["n"]


def tree_shard(rows: DataFrame, key: str, leaves: Sequence[Leaf], name: str) -> DataFrame:
    """Adds column ``name``: the shard that a string column ``key`` descends to.

    At each level the children draw against each other by their subtree
    weights, each with a hash of the key and its own name. When weights
    change, only the draws of the changed children change, so rows move only
    into or out of the subtrees that changed.
    """
    region, rack = f"_{name}_region", f"_{name}_rack"
    tree: dict[str, dict[str, dict[str, float]]] = {}
    for leaf in leaves:
        tree.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[str(leaf.shard)] = leaf.weight

    rows = rows.withColumn(region, _pick(F.col(key), "", {r: sum(sum(s.values()) for s in t.values()) for r, t in tree.items()}))
    racks = F.lit(None).cast("string")
    for r, t in tree.items():
        racks = F.when(F.col(region) == r, _pick(F.col(key), r, {k: sum(s.values()) for k, s in t.items()})).otherwise(racks)
    rows = rows.withColumn(rack, racks)
    shards = F.lit(None).cast("string")
    for r, t in tree.items():
        for k, s in t.items():
            here = (F.col(region) == r) & (F.col(rack) == k)
            shards = F.when(here, _pick(F.col(key), f"{r}/{k}", s)).otherwise(shards)
    return rows.withColumn(name, shards.cast("int")).drop(region, rack)


def shard_documents(docs: DataFrame, leaves: Sequence[Leaf], grown: Sequence[Leaf]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs(doc_id, text)``.

    The law is ``key``: doc_id and the tree alone decide, so rows of one id
    stay together and copies of a text under other ids do not. ``slot``
    numbers the rows of a shard from 0 without gaps, in the order of a hash
    of id, size and checksum.

    A null doc_id is a key of its own. A null text has size 1 and a null
    checksum; an empty one size 1 and checksum 0. Rows equal in all three
    columns get slots next to each other. Other columns are ignored; no rows
    give no rows.

    Equal rows are counted per input split before the shuffle. Numbering
    adds the count of all earlier hash ranges of the shard to the place in
    the row's own range.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.spark_partition_id().alias("split"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "split").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = tree_shard(tree_shard(rows, "key", leaves, "shard"), "key", grown, "grown_shard")
    place = F.md5(F.concat_ws(",", "key", "size", F.coalesce(F.col("text_crc32"), F.lit(-1))))
    rows = rows.withColumn("place", place).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    rows = settle(rows, "shards")

    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = "sum(n) over (partition by shard order by bucket) - n as before"
    starts = counts.selectExpr("shard", "bucket", before)
    within = "sum(copies) over (partition by shard, bucket order by place, split rows unbounded preceding) - copies"
    numbered = rows.selectExpr("*", f"{within} as within").join(starts, ["shard", "bucket"])
    numbered = numbered.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return numbered.selectExpr(
        "doc_id", "size", "text_crc32", "'key' as law", "shard", "before + within + copy as slot", "grown_shard"
    )
