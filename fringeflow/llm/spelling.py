"""Group spelling variants: words one edit apart, found by Gram matrices of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.memory import returning_memory
from fringeflow.sources.stage_store import settle

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A block of more words is halved, and rows of a Gram matrix, unless one block has more.
BLOCK_WORDS = 1024
GRAM_ROWS = 256
# Letters share this many counts, by code point.
COUNTS = 64


def varied_words(docs: DataFrame, min_chars: int, delete_one_in: int) -> DataFrame:
    """``word, n`` of all words of ``docs(doc_id, text)``: letter runs, lower-cased in A-Z.

    A run loses its letter number ``h % length`` where ``delete_one_in``
    divides ``h``, the checksum of ``<doc_id>:<run>`` (a null id counts as
    empty text). Words under ``min_chars`` letters after that are left out.
    """
    runs = docs.selectExpr(
        "coalesce(cast(doc_id as string), '') as id",
        f"explode(regexp_extract_all(text, '[{LETTERS}]{{{min_chars},}}', 0)) as run",
    )
    lowered = runs.selectExpr("id", f"if(run rlike '[A-Z]', translate(run, '{UPPER}', '{LOWER}'), run) as run")
    hashed = lowered.selectExpr("run", "crc32(cast(concat(id, ':', run) as binary)) as h")
    at = "cast(h % length(run) as int)"
    words = hashed.selectExpr(
        f"if(h % {delete_one_in} = 0, concat(substring(run, 1, {at}), substring(run, {at} + 2)), run) as word"
    )
    return words.where(f"length(word) >= {min_chars}").groupBy("word").agg(F.count("*").alias("n"))


def _blocks(words: DataFrame) -> DataFrame:
    """Each word in the blocks where its near words can be: ``block, m, s, e, word, n``.

    Two near words of lengths ``m`` and ``m`` or ``m + 1`` agree but for one
    place. A block holds the words of these two lengths that agree before
    place ``s`` and in their last ``m - e`` letters; the near words whose edit
    is between are in it together. A word starts with two blocks, edit in the
    first or in the second half, for either length that may be the shorter.
    """
    rows = words.selectExpr("word", "n", "explode(array(length(word), length(word) - 1)) as m")
    halves = "array(struct(0 as s, m div 2 as e), struct(m div 2 as s, m as e))"
    rows = rows.selectExpr("word", "n", "cast(m as int) as m", f"explode({halves}) as part")
    return _keyed(rows.selectExpr("word", "n", "m", "cast(part.s as int) as s", "cast(part.e as int) as e"))


def _keyed(rows: DataFrame) -> DataFrame:
    known = "xxhash64(m, s, e, substring(word, 1, s), right(word, m - e))"
    return rows.selectExpr(f"{known} as block", "m", "s", "e", "word", "n")


def bounded_blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of at most ``most`` words, or with one place between ``s`` and ``e``.

    Blocks with more words are halved between ``s`` and ``e``, all their
    words alike, until there are none. The latter have no more words than the
    letters of the alphabet make, so no block grows with the number of words.
    """
    rows = _blocks(words)
    while True:
        large = rows.where("e - s > 1").groupBy("block").count().where(f"count > {most}").select("block")
        large = settle(large, "large_blocks")
        if large.isEmpty():
            return rows
        marked = rows.join(large.withColumn("halve", F.lit(True)), "block", "left")
        middle = "s + (e - s) div 2"
        parts = f"if(halve and e - s > 1, array(struct(s as s, {middle} as e), struct({middle} as s, e as e)), array(struct(s as s, e as e)))"
        split = marked.selectExpr("word", "n", "m", f"explode({parts}) as part")
        rows = settle(
            _keyed(split.selectExpr("word", "n", "m", "cast(part.s as int) as s", "cast(part.e as int) as e")), "blocks"
        )


def first_difference(a: str, b: str) -> int:
    """Place of the one edit that makes ``a`` into ``b``, as long or one longer; -1 if it takes more or none."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return at if at < len(a) and a[at + 1 :] == b[at + 1 :] else -1
    return at if a[at:] == b[at + 1 :] else -1


def letter_counts(words: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(owner * COUNTS + points % COUNTS, minlength=len(words) * COUNTS)
    return flat.reshape(len(words), COUNTS).astype(np.float32)


def close_pairs(words: list[str], owner: np.ndarray, length: np.ndarray, shorter: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of one block whose letter counts are at most 2 apart, squared: the first one of the shorter length.

    The product of the count matrix with itself gives all squared distances
    of the rows; an edit changes them by 1 (a letter more) or by 2 at most
    (one for another).
    """
    counts = letter_counts(words)
    for start in range(0, len(words), GRAM_ROWS):
        rows = slice(start, start + GRAM_ROWS)
        # Rows are sorted by block: the others of these rows' blocks lie in one stretch.
        low, high = np.searchsorted(owner, owner[start]), np.searchsorted(owner, owner[rows][-1], "right")
        mine, others = counts[rows], counts[low:high]
        squared = (mine * mine).sum(axis=1)[:, None] + (others * others).sum(axis=1) - 2 * (mine @ others.T)
        near = (squared <= 2) & (owner[rows][:, None] == owner[low:high])
        near &= (length[rows] == shorter[rows])[:, None]
        of_same = length[rows][:, None] == length[low:high]
        near &= ~of_same | (np.arange(start, start + len(mine))[:, None] < np.arange(low, high))
        for i, j in np.argwhere(near).tolist():
            yield start + i, low + j


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of each block: how many are near by an edit between ``s`` and ``e``, and the most frequent of them."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        block, m, s, e, n = (rows[c].to_numpy() for c in ("block", "m", "s", "e", "n"))
        words = rows["word"].to_pylist()
        new = np.r_[True, (block[1:] != block[:-1]) | (m[1:] != m[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])]
        owner = np.cumsum(new)
        sizes = np.bincount(owner)
        keep = np.flatnonzero(sizes[owner] > 1)
        words, n = [words[i] for i in keep], n[keep].tolist()
        s, e, m, owner = s[keep].tolist(), e[keep].tolist(), m[keep], owner[keep]
        length = np.array([len(w) for w in words], dtype=np.int64)
        found: dict[int, list] = {}
        for i, j in close_pairs(words, owner, length, m) if words else ():
            at = first_difference(words[i], words[j])
            if at >= 0 and s[i] <= min(at, len(words[i]) - 1) < e[i]:
                for a, b in ((i, j), (j, i)):
                    best = (-n[b], words[b])
                    if seen := found.get(a):
                        seen[0] += 1
                        seen[1] = min(seen[1], best)
                    else:
                        found[a] = [1, best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[a] for a in found], pa.string()),
                pa.array([x[0] for x in found.values()], pa.int64()),
                pa.array([-x[1][0] for x in found.values()], pa.int64()),
                pa.array([x[1][1] for x in found.values()], pa.string()),
            ],
            ["word", "n_near", "near_n", "near"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last block may go on in the next batch.
        block = batch.column("block").to_numpy()
        whole = int(np.searchsorted(block, block[-1]))
        held.append(batch.slice(0, whole))
        if whole:
            yield done(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(whole))
    if held:
        yield done(pa.Table.from_batches(held))


def near_words(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """``word, n_near, near, near_n`` for each word of ``words(word, n)`` that has a near word.

    ``near`` is the near word of largest ``n``, of equal ones the smallest
    in code-point order.
    """
    blocks = bounded_blocks(words, most).repartition("block").sortWithinPartitions("block", "m", "s", "e")
    schema = "word string, n_near long, near_n long, near string"
    parts = blocks.mapInArrow(returning_memory(_near_in_blocks), schema)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    sums = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return sums.selectExpr("word", "n_near", "best.near as near", "-best.order as near_n")


def follow(links: DataFrame, rounds: int) -> DataFrame:
    """``word, root`` for each of ``links(word, form)``: the end of its chain of forms.

    Each round replaces every word's target by the target's own, so chains of
    up to ``2**rounds`` links come to their end.
    """
    ends = links.selectExpr("word", "form as root")
    for _ in range(rounds):
        ends = settle(ends, "roots")
        onward = ends.selectExpr("word as root", "root as further")
        ends = ends.join(onward, "root", "left").selectExpr("word", "coalesce(further, root) as root")
    return ends


def variant_groups(
    docs: DataFrame, min_chars: int, min_count: int, ratio: int, delete_one_in: int, most: int = BLOCK_WORDS
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of ``docs(doc_id, text)``.

    Words are ``varied_words`` found at least ``min_count`` times. A word's
    form is its near word of largest ``n``, if that is at least ``ratio``
    times its own; its root is the end of its chain of forms, or itself.
    ``n`` grows by ``ratio`` along each link, which bounds the chain.

    Letter counts are compared in blocks that hold two adjacent lengths and
    agree in half of their letters or more (``bounded_blocks``). Null and
    empty texts have no words, repeated rows count one by one, other columns
    are ignored, and no rows give no rows.
    """
    counted = varied_words(docs.select("doc_id", "text"), min_chars, delete_one_in)
    words = settle(counted.where(f"n >= {min_count}"), "words")
    joined = words.join(near_words(words, most), "word", "left")
    has_form = f"near_n >= {ratio} * n"
    judged = joined.selectExpr(
        "word",
        f"if({has_form}, near, null) as form",
        "n",
        "coalesce(n_near, 0L) as n_near",
        f"if({has_form}, near_n, null) as form_n",
    )
    judged = settle(judged, "forms")
    largest = judged.selectExpr("max(n) as n").first()["n"] or 0
    steps = rounds = 0
    while min_count * ratio ** (steps + 1) <= largest and ratio > 1:
        steps += 1
    while 1 << rounds < steps:
        rounds += 1
    roots = follow(judged.where("form is not null").select("word", "form"), rounds)
    return judged.join(roots, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) as root", "n", "n_near", "form_n"
    )
