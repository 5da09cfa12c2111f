"""Nearest neighbours by inner product with a forest of sorted hash strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.sources.stage_store import settle

TREES = 64
# Bits of a hash string.
BITS = 32
# Rows of a shard, each with a forest of its own, and queries that visit it at once.
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
# Share of a shard's distinct vectors that a query ascends for.
ENOUGH = 0.45
SEED = 7


class HashForest:
    """Sorted arrays of hash strings of distinct vectors, one array for each tree.

    A bit is the side of a random plane. Vectors get one more component that
    makes all lengths equal, so that near means a large inner product.
    """

    def __init__(self, vectors: np.ndarray, longest: float) -> None:
        rng = np.random.default_rng(SEED)
        self.planes = rng.standard_normal((TREES, vectors.shape[1] + 1, BITS)).astype(np.float32)
        self.size = len(vectors)
        missing = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        strings = self.strings(np.c_[vectors, missing])
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, points: np.ndarray) -> np.ndarray:
        """Hash string of each point in each tree, as an unsigned number."""
        points = (points / np.abs(points).max(axis=1, keepdims=True).clip(1e-300)).astype(np.float32)
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((points @ p) > 0) @ weights for p in self.planes])

    def candidates(self, queries: np.ndarray, least: int) -> np.ndarray:
        """A row for each query that marks its candidates.

        Each query descends every tree to its longest matching prefix. From
        there all trees ascend together, one bit at a time, until the strings
        that share the prefix are enough distinct vectors, at least ``least``. Whole prefixes
        are taken, so equal strings come together.
        """
        strings = self.strings(np.c_[queries, np.zeros(len(queries))])
        enough = min(self.size, max(least, int(np.ceil(ENOUGH * self.size))))
        marked = np.zeros((len(queries), self.size), dtype=bool)
        active = np.arange(len(queries))
        for depth in range(BITS, -1, -1):
            rest = np.uint64((1 << (BITS - depth)) - 1)
            wanted = strings[:, active]
            low = np.stack([np.searchsorted(s, w & ~rest, "left") for s, w in zip(self.sorted, wanted)])
            high = np.stack([np.searchsorted(s, w | rest, "right") for s, w in zip(self.sorted, wanted)])
            # Ranges of all trees together must hold enough before any is looked at.
            for i in np.flatnonzero((high - low).sum(axis=0) >= enough):
                row = marked[active[i]]
                for tree in np.flatnonzero(high[:, i] > low[:, i]):
                    row[self.order[tree, low[tree, i] : high[tree, i]]] = True
            active = active[marked[active].sum(axis=1) < enough]
            if not len(active):
                break
        return marked


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, summed component by component, so that equal vectors get equal scores."""
    total = np.zeros(len(left))
    for x, y in zip(left.T, right.T):
        total += x * y
    return total


def search_shard(rows: pd.DataFrame, queries: pd.DataFrame, longest: float, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of each query among the rows of one shard."""
    found: list[tuple[np.ndarray, ...]] = []
    if len(rows) and len(queries):
        rows = rows.sort_values("vec_id")
        ids = rows["vec_id"].to_numpy()
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        distinct, member = np.unique(vectors, axis=0, return_inverse=True)
        member = member.ravel()
        by_vector = np.argsort(member, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(member, minlength=len(distinct)))]
        forest = HashForest(distinct, longest)
        query_ids = queries["vec_id"].to_numpy()
        points = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
        for start in range(0, len(points), 256):
            block = points[start : start + 256]
            marked = forest.candidates(block, k + 1)
            near = np.where(marked, block @ distinct.T, -np.inf)
            # One more than k, as a query may find itself.
            kth = np.partition(near, -min(k + 1, len(distinct)), axis=1)[:, -min(k + 1, len(distinct))]
            slack = 1e-9 * longest * np.linalg.norm(block, axis=1)
            q, v = np.nonzero(marked & (near >= (kth - slack)[:, None]))
            # The smallest ids of each vector; more copies cannot be among the best.
            copies = np.minimum(starts[v + 1] - starts[v], k + 1)
            place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row = by_vector[np.repeat(starts[v], copies) + place]
            scores = np.repeat(exact_products(block[q], distinct[v]), copies)
            q = np.repeat(q, copies) + start
            other = ids[row] != query_ids[q]
            q, row, scores = q[other], row[other], scores[other]
            best = np.lexsort((ids[row], -scores, q))
            q, row, scores = q[best], row[best], scores[best]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            top = rank < k
            found.append((query_ids[q[top]], ids[row[top]], scores[top]))
    columns = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))


def nearest_neighbours(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found to each query in ``vectors(vec_id, embedding)``.

    ``queries`` is a condition on the rows that ask. Rows are dealt to shards
    of bounded size by a hash of the id; each block of queries visits every
    shard, whose forest yields candidates, and candidates are ranked by exact
    inner product in double precision, ties by the smaller id. The best of
    all shards are merged. Equal vectors of a shard are one entry of its
    forest, however many they are.

    Vectors that are null, zero, of another than the largest dimension, or
    hold null or non-finite components take no part, nor do null ids. Of rows
    that share an id the least vector counts; a query is never its own
    neighbour. Other columns are ignored; no rows give no rows.
    """
    usable = """vec_id is not null and embedding is not null and forall(embedding, x -> x is not null
        and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"""
    rows = vectors.where(usable).selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = settle(rows.withColumn("asks", F.expr(queries)), "vectors")
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = rows.where(F.size("embedding") == size)
    longest = "max(aggregate(embedding, 0d, (s, x) -> s + x * x))"
    n, n_queries, square = rows.selectExpr("count(*)", "count_if(asks)", longest).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    reach = float(square or 0) ** 0.5

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_shard(left, right, reach, k)

    own = "cast(pmod(xxhash64(vec_id), {}) as int)"
    each = "explode(sequence(0, {} - 1))"
    indexed = rows.selectExpr("vec_id", "embedding", f"{own.format(shards)} as shard", f"{each.format(blocks)} as block")
    asking = rows.where("asks")
    asking = asking.selectExpr("vec_id", "embedding", f"{each.format(shards)} as shard", f"{own.format(blocks)} as block")
    id_type = dict(rows.dtypes)["vec_id"]
    found = (
        indexed.groupBy("shard", "block")
        .cogroup(asking.groupBy("shard", "block"))
        .applyInPandas(search, f"query_id {id_type}, vec_id {id_type}, score double")
    )
    rank = "row_number() over (partition by query_id order by score desc, vec_id) as rank"
    return found.selectExpr("query_id", rank, "vec_id", "score").where(f"rank <= {k}")
