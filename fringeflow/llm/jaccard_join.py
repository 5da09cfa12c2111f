"""Link documents whose word shingle sets overlap almost wholly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.components import connected_components
from fringeflow.llm.matching import BROADCAST_KEYS, small_or_shuffled
from fringeflow.llm.memory import returning_memory
from fringeflow.llm.shingles import BUCKETS, WordHasher, run_levels, word_buckets
from fringeflow.sources.stage_store import SETTLED, keep_settled, settle

# At most so many frequent shingles, eight bytes each, are sent to all tasks.
FREQUENT = 1 << 16
# Shingles in fewer sets than this are never called frequent.
RARE = 64
# Levels of words that are twice as common differ by this.
LEVEL_STEP = 6
# Words counted at once.
WORDS = 1 << 20

# Classes of a list that are paired; those of a longer one belong to one family without pairs.
SHORT = 64
# The same for lists of differences.
SHORT_DIFFERENCES = 16
# Members whose elements give a group's centre, about.
SAMPLE = 24
# Times that families of more than ``CHUNK`` classes are divided before what is left is compared in full.
LEVELS = 3
# Edges that one task joins to components: 256 KB.
EDGES = 1 << 14

NONE = np.zeros(0, dtype=np.uint64)

# Sets of a family that meet others in one task, and elements multiplied at once.
CHUNK = 256
ELEMENTS = 4096

Batches = Iterator[pa.RecordBatch]


def prefix_size(n: int, percent: int) -> int:
    """Two sets similar enough share one of their first so many elements in any common order."""
    return n - -(-percent * n // 100) + 1


def block_width(percent: int) -> float:
    """Logarithms of the sizes of similar sets differ by less."""
    return math.log(100 / percent) + 1e-9


def hinted(table: DataFrame) -> DataFrame:
    """A settled table, with a hint to broadcast it if it has at most ``BROADCAST_KEYS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_KEYS else table


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def count_batches(batches: Batches) -> Batches:
    """``bucket, count`` of the words of all texts, one row for each bucket and task at most."""
    hasher, counts = WordHasher(), np.zeros(BUCKETS, dtype=np.int64)
    held, size = [np.zeros(0, dtype=np.int64)], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.append(word_buckets(hasher.words(text or "")))
            size += len(held[-1])
            if size >= WORDS:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = held[:1], 0
    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "count"])


def word_levels(docs: DataFrame) -> np.ndarray:
    """How common the words of each bucket are, as a logarithm; 256 KB at every size."""
    counts = docs.select("text").mapInArrow(returning_memory(count_batches), "bucket long, count long")
    counts = counts.groupBy("bucket").agg(F.sum("count").alias("count"))
    rows = settle(counts.selectExpr("bucket", f"cast(round({LEVEL_STEP} * log2(count)) as long) as level"), "words").toArrow()
    levels = np.zeros(BUCKETS, dtype=np.uint8)
    levels[rows["bucket"].to_numpy()] = np.minimum(rows["level"].to_numpy(), 255)
    return levels


def set_batches(
    width: int, percent: int | None, levels: np.ndarray, frequent: np.ndarray
) -> Callable[[Batches], Batches]:
    """Size, 128-bit digest and elements of each text's set: the prefix only, or all without ``percent``.

    A prefix takes shingles of rare words first, by the sum of their words'
    levels and then by hash, and ``frequent`` ones last. It is empty if one
    element more or less already makes a set too different.
    """

    def prefix(words: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens, first = np.unique(runs, return_index=True)
        if 100 * len(tokens) < percent * (len(tokens) + 1):
            return tokens, tokens[:0]
        level = run_levels(words, len(runs), levels)[first]
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
            level[frequent[at] == tokens] += 1 << 40
        return tokens, tokens[np.argsort(level, kind="stable")][: prefix_size(len(tokens), percent)]

    def run(batches: Batches) -> Batches:
        hasher = WordHasher()
        for batch in batches:
            sizes, digests, kept = [], [], []
            for text in batch.column("text").to_pylist():
                words = hasher.words(text or "")
                runs = hasher.runs(words, width)
                if percent is None:
                    tokens = elements = np.unique(runs)
                else:
                    tokens, elements = prefix(words, runs)
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                kept.append(elements)
            columns = [batch.column("doc_id"), batch.column("code"), pa.array(sizes, pa.int64())]
            columns += [pa.array(digests, pa.binary()), long_lists(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "n", "digest", "tokens"])

    return run


def shingle_sets(
    docs: DataFrame, width: int, percent: int | None = None, levels: np.ndarray = NONE, frequent: np.ndarray = NONE
) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, code long, n long, digest binary, tokens array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("code")).mapInArrow(
        returning_memory(set_batches(width, percent, levels, frequent)), schema
    )


def shared_tokens(classes: DataFrame) -> DataFrame:
    """``token, count`` of the prefix elements of more than one class."""
    tokens = classes.select(F.explode("tokens").alias("token"))
    return settle(tokens.groupBy("token").count().where("count > 1"), "shared")


def frequent_tokens(shared: DataFrame) -> DataFrame:
    """Of shingles in ``RARE`` prefixes or more the most frequent ones, at most ``FREQUENT``.

    Any choice leaves the join exact: these shingles only move to the end of
    the order, where prefixes seldom reach.
    """
    steps = shared.where(f"count >= {RARE}").withColumn("step", F.expr("cast(floor(16 * log2(count)) as int)"))
    least, held = None, 0
    for row in sorted(steps.groupBy("step").count().collect(), reverse=True):
        held += row["count"]
        if held > FREQUENT:
            break
        least = row.step
    return steps.where(F.lit(False) if least is None else F.col("step") >= least).select("token")


def without_frequent(
    classes: DataFrame, shared: DataFrame, docs: DataFrame, width: int, percent: int, levels: np.ndarray
) -> DataFrame:
    """The classes again, with the frequent shingles at the end of the order; the same ones if there are none.

    Only prefixes that hold such a shingle change, so only those are made anew.
    """
    found = frequent_tokens(shared)
    rows = found.collect()
    if not rows:
        return classes
    frequent = np.sort(np.array([r.token for r in rows], dtype=np.int64).view(np.uint64))
    held = classes.select("class", F.explode("tokens").alias("token"))
    held = hinted(settle(held.join(F.broadcast(found), "token", "left_semi").select("class").distinct(), "held"))
    make = lambda rows: shingle_sets(rows, width, percent, levels, frequent)
    changed = class_sets(held, classes, docs, make).select(*classes.columns)
    return settle(classes.join(held, "class", "left_anti").unionByName(changed), "classes")


def inverted_lists(classes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """``token, window, at, n, block, class, least, length, root``: lists of the prefix elements that classes share.

    A block holds similar sizes, and a window a block and the next one, so
    similar sets meet in the window of the lower block. ``least`` is the
    least overlap a similar partner in the window can have; entries at
    positions that leave fewer elements are skipped there. ``length`` counts
    a list, ``root`` is its least class. Lists of one class, and those that
    have no set of the window's own block, are left out.
    """
    ratio = block_width(percent)
    entries = classes.select(F.posexplode("tokens").alias("at", "token"), "n", "class")
    since = len(SETTLED)
    entries = settle(entries.join(hinted(shared.select("token")), "token"), "common")
    entries = entries.withColumn("block", F.expr(f"cast(floor(ln(n) / {ratio}) as int)"))
    entries = entries.withColumn("window", F.explode(F.expr("array(block - 1, block)")))
    smallest = f"greatest(cast(floor(exp(window * {ratio} - 1e-9)) as long), ({percent} * n + 99) div 100)"
    least = f"({percent} * (n + {smallest}) + {99 + percent}) div {100 + percent}"
    entries = entries.withColumn("least", F.expr(least)).where("n - at >= least")
    heads = entries.groupBy("token", "window").agg(
        F.count("*").alias("length"), F.min("class").alias("root"), F.bool_or(F.expr("block = window")).alias("own")
    )
    lists = settle(entries.join(heads.where("length > 1 and own").drop("own"), ["token", "window"]), "lists")
    keep_settled(classes.sparkSession, since, SETTLED[-1:])
    return lists


def short_list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` from lists of at most ``SHORT`` classes that may be similar enough.

    Similar sets that meet in no longer list have at least ``needed`` of
    these in common: the one whose prefix ends first can miss only as many
    elements as ``least`` leaves. The first common element leaves an
    overlap behind it in both sets.
    """
    short = lists.where(f"length <= {SHORT}")
    sides = [
        short.selectExpr("token", "window", *[f"{c} as {c}_{s}" for c in ("at", "n", "block", "least", "class")])
        for s in "ab"
    ]
    overlap = f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"
    met = sides[0].where("block_a = window").join(sides[1], ["token", "window"])
    met = met.where(
        f"""(block_b > window or class_a < class_b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)
        and least(least_a, least_b) <= {overlap}"""
    )
    found = met.groupBy("class_a", "class_b").agg(
        F.count("*").alias("common"),
        F.expr(f"any_value({overlap} + 1 - greatest(least_a, least_b))").alias("needed"),
        F.expr(f"max(least(n_a - at_a, n_b - at_b) - {overlap})").alias("behind"),
    )
    return found.where("common >= needed and behind >= 0").selectExpr("class_a as a", "class_b as b")


def list_families(lists: DataFrame, percent: int) -> DataFrame:
    """``class, family``: classes that may be similar, directly or through others.

    These are the pairs of short lists, and all that meet in a longer one.
    """
    long = lists.where(f"length > {SHORT}").selectExpr("class as src", "root as dst")
    edges = long.unionByName(short_list_pairs(lists, percent).selectExpr("a as src", "b as dst"))
    return connected_components(edges, EDGES).selectExpr("node as class", "component as family")


def centred(families: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """``family, class, n, diff``: the classes' differences from their family's centre.

    A centre holds the elements that over half of about ``SAMPLE`` members
    have, and any centre leaves the join exact. Elements that fewer, but more
    than one, of these have come last in ``diff``.
    """
    sizes = families.groupBy("family").agg(F.count("*").alias("members"))
    drawn = families.join(sizes, "family").where(f"pmod(xxhash64(class, {level}), members) < {SAMPLE}")
    drawn = small_or_shuffled(drawn.selectExpr("family", "class", f"least(members, {SAMPLE}) as drawn"))
    # A family's drawn sets are few, so they are counted where they meet, without another shuffle.
    counts = sets.join(drawn, "class").repartition("family").select("family", "drawn", F.explode("tokens").alias("token"))
    counts = counts.groupBy("family", "token").agg(F.count("*").alias("count"), F.any_value("drawn").alias("drawn"))
    counts = counts.where("count > 1")
    centres = counts.groupBy("family").agg(
        F.expr("collect_list(token) filter (where 2 * count > drawn)").alias("centre"),
        F.expr("collect_list(token) filter (where 2 * count <= drawn)").alias("late"),
    )
    none = "cast(array() as array<long>)"
    members = sets.join(hinted(families), "class")
    members = members.join(settle(centres, "centres"), "family", "left")
    members = members.selectExpr("family", "class", "tokens", f"coalesce(centre, {none}) centre", f"coalesce(late, {none}) late")
    diff = "concat(array_except(tokens, centre), array_except(centre, tokens))"
    diff = members.selectExpr("family", "class", "cast(size(tokens) as long) as n", f"{diff} as diff", "late")
    return diff.selectExpr("family", "class", "n", "concat(array_except(diff, late), array_intersect(diff, late)) as diff")


def derived_links(families: DataFrame, sets: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst`` of similar sets of each family, and the families ``class, family, members`` still to be joined.

    Answers follow from the differences to the centre. With
    ``cost = (100 + percent) * size(diff) - (100 - percent) * n``, two sets
    are similar exactly if the sum of their costs is at most ``2 * (100 +
    percent)`` times the size of what their differences have in common. So
    all that cost little enough beside the family's cheapest set are similar
    to it, without a comparison, and need no links among each other. The
    others must share differences: these go into lists, by the prefix that
    the least overlap with a set of about its size leaves. Short lists are
    paired, longer ones make up the families of the next level, which have a
    nearer centre.
    """
    since, twice = len(SETTLED), 2 * (100 + percent)
    block = f"cast(floor(ln(n) / {block_width(percent)}) as int)"
    diffs = centred(families, sets, level).withColumn(
        "cost", F.expr(f"{100 + percent} * cast(size(diff) as long) - {100 - percent} * n")
    )
    diffs = settle(diffs.withColumn("block", F.expr(block)), "diffs")
    best = diffs.groupBy("family").agg(F.expr("min(struct(cost, class))").alias("best"), F.max("cost").alias("dearest"))
    best = small_or_shuffled(best.selectExpr("family", "best.cost as lowest", "best.class as nearest", "dearest"))
    placed = diffs.join(best, "family").withColumn("outer", F.expr("cost + lowest > 0"))
    links = placed.where("not outer and class <> nearest").selectExpr("class as src", "nearest as dst")

    # A set that is linked to the cheapest one only has to meet others that are not.
    open_ = placed.where("dearest + lowest > 0")
    near = open_.select("family", F.explode(F.expr("array(block - 1, block, block + 1)")).alias("block"), "cost", "outer")
    near = near.groupBy("family", "block").agg(
        F.min("cost").alias("any_cost"), F.expr("min(cost) filter (where outer)").alias("outer_cost")
    )
    open_ = open_.join(small_or_shuffled(near), ["family", "block"])
    open_ = open_.withColumn("partner", F.expr("if(outer, any_cost, outer_cost)")).where("partner is not null")
    prefix = f"slice(diff, 1, greatest(0, size(diff) + 1 - cast(ceil((cost + partner) / {twice}.0D) as int)))"
    entries = open_.select("family", "class", "outer", F.explode(F.expr(prefix)).alias("token"))
    heads = entries.groupBy("family", "token").agg(
        F.count("*").alias("length"), F.min("class").alias("root"), F.bool_or("outer").alias("wanted")
    )
    heads = small_or_shuffled(heads.where("length > 1 and wanted").drop("wanted"))
    lists = settle(entries.join(heads, ["family", "token"]), "lists")
    short = lists.where(f"length <= {SHORT_DIFFERENCES}")
    left, right = (short.selectExpr("family", "token", f"class as {s}", f"outer as outer_{s}") for s in "ab")
    met = left.join(right, ["family", "token"]).where("a < b and (outer_a or outer_b)")
    pairs = settle(met.select("a", "b").distinct(), "pairs")
    x, y = (diffs.selectExpr(f"class as {s}", f"diff as diff_{s}", f"cost as cost_{s}") for s in "ab")
    judged = pairs.join(x, "a").join(y, "b")
    judged = judged.where(f"cost_a + cost_b <= {twice} * cast(size(array_intersect(diff_a, diff_b)) as long)")
    links = links.unionByName(judged.selectExpr("a as src", "b as dst"))

    long = lists.where(f"length > {SHORT_DIFFERENCES}").selectExpr("class as src", "root as dst")
    rest = connected_components(long, EDGES).selectExpr("node as class", "component as family")
    rest = rest.join(rest.groupBy("family").agg(F.count("*").alias("members")), "family")
    links, rest = settle(links, "links"), settle(rest, "families")
    keep_settled(sets.sparkSession, since, SETTLED[-2:])
    return links, rest


def family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``src, dst`` that connect the similar classes of each family, level by level.

    Of what a level leaves, families of at most ``CHUNK`` classes are
    compared in full, each in one task; larger ones are divided again, and
    after ``LEVELS`` levels compared in full too, chunk by chunk.
    """
    found = sets.selectExpr("class as src", "class as dst").limit(0)
    if families.isEmpty():
        return found
    rest = families.join(families.groupBy("family").agg(F.count("*").alias("members")), "family")
    for level in range(LEVELS):
        divided = rest
        if level:
            if (rest.agg(F.max("members")).first()[0] or 0) <= CHUNK:
                break
            found = found.unionByName(compared_links(rest.where(f"members <= {CHUNK}"), sets, percent))
            divided = rest.where(f"members > {CHUNK}")
        links, rest = derived_links(divided.select("class", "family"), sets, percent, level)
        found = found.unionByName(links)
    return found.unionByName(compared_links(rest, sets, percent))


def joined_members(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one it is connected with through similar sets.

    Overlaps of all pairs come from products of the sets' membership
    matrix, a stretch of elements at a time.
    """
    sizes = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    for start in range(0, int(element[-1]) + 1, ELEMENTS):
        low, high = np.searchsorted(element, [start, start + ELEMENTS])
        member = np.zeros((len(sets), ELEMENTS), dtype=np.float32)
        member[owner[low:high], element[low:high] - start] = 1
        common += member @ member.T
    similar = (100 + percent) * common.astype(np.int64) >= percent * (sizes[:, None] + sizes)
    place = np.arange(len(sets))
    while True:
        least = np.where(similar, place, len(sets)).min(axis=1)
        least = least[least]
        if (least == place).all():
            return place
        place = least


def family_batches(percent: int) -> Callable[[Batches], Batches]:
    """Edges that connect similar sets of a family; rows come sorted by family and meeting."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        classes = table.column("class").to_numpy()
        sets = [np.array(x, dtype=np.int64) for x in table.column("tokens").to_pylist()]
        place = joined_members(sets, percent)
        moved = np.flatnonzero(place != np.arange(len(place)))
        return pa.RecordBatch.from_arrays([pa.array(classes[moved]), pa.array(classes[place[moved]])], ["src", "dst"])

    def run(batches: Batches) -> Batches:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held else table
            keys = np.stack([held.column(c).to_numpy() for c in ("family", "low", "high")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for first, last in zip(np.r_[0, cuts[:-1]], cuts):
                if last - first > 1:
                    yield judged(held.slice(first, last - first))
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and len(held) > 1:
            yield judged(held)

    return run


def compared_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``src, dst`` that connect the similar classes of each family, by comparing all of them.

    A family is dealt to chunks of about ``CHUNK`` sets, and each pair of
    chunks meets in a task.
    """
    chunks = f"cast(ceil(members / {CHUNK}) as int)"
    dealt = sets.join(families, "class").withColumn("own", F.expr(f"cast(pmod(xxhash64(class), {chunks}) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr(f"sequence(0, {chunks} - 1)")))
    dealt = dealt.selectExpr("family", "least(own, other) as low", "greatest(own, other) as high", "class", "tokens")
    key = ["family", "low", "high"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(returning_memory(family_batches(percent)), "src long, dst long")


def class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``class, n, doc_id, digest, tokens`` of the wanted classes, made anew from one text of each."""
    members = hinted(settle(classes.select("class", "digest", "doc_id").join(wanted.select("class"), "class"), "members"))
    rows = docs.join(members.selectExpr("doc_id as _member"), F.expr("doc_id <=> _member"), "left_semi")
    sets = make(rows).select("digest", "n", "tokens").join(members, "digest").groupBy("class")
    return sets.agg(*[F.any_value(c).alias(c) for c in ("n", "doc_id", "digest", "tokens")])


def linked_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows, ``doc_id, code, n, digest``, and the component of each distinct non-empty one, ``digest, doc_id, component``.

    The ``doc_id`` of a distinct set is the least of its rows. Both are
    settled; what else was settled on the way is deleted.
    """
    spark, since = docs.sparkSession, len(SETTLED)
    levels = word_levels(docs)
    sets = settle(shingle_sets(docs, width, percent, levels), "sets")
    classes = sets.where("n > 0").groupBy("digest")
    classes = classes.agg(F.any_value("n").alias("n"), F.min("doc_id").alias("doc_id"), F.any_value("tokens").alias("tokens"))
    classes = settle(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    class_path = SETTLED[-1]
    rows = settle(sets.drop("tokens"), "rows")
    row_path = SETTLED[-1]
    keep_settled(spark, since, [row_path, class_path])

    shared = shared_tokens(classes)
    ordered = without_frequent(classes, shared, docs, width, percent, levels)
    if ordered is not classes:
        classes, class_path = ordered, SETTLED[-1]
        keep_settled(spark, since, [row_path, class_path])
        shared = shared_tokens(classes)
    families = settle(list_families(inverted_lists(classes, shared, percent), percent), "families")
    keep_settled(spark, since, [row_path, class_path, SETTLED[-1]])
    full = settle(class_sets(families, classes, docs, lambda found: shingle_sets(found, width)).select("class", "tokens"), "sets")
    places = settle(connected_components(family_links(families, full, percent), EDGES), "places")
    keep_settled(spark, since, [row_path, class_path, SETTLED[-1]])

    named = classes.select("digest", "class", "doc_id")
    named = named.join(places.selectExpr("node as class", "component"), "class", "left")
    named = settle(named.select("digest", "doc_id", F.coalesce("component", "class").alias("component")), "named")
    keep_settled(spark, since, [row_path, SETTLED[-1]])
    return rows, named


def jaccard_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    A text's set holds its distinct runs of ``width`` words; two link when
    the sets' Jaccard similarity is at least ``percent`` / 100. The join is
    exact up to collisions of 64-bit hashes.

    Equal sets become one class. Classes meet in inverted lists of their
    prefixes, in blocks of similar sizes, where positions that leave too
    small an overlap are skipped. Only short lists are paired; longer ones,
    and the pairs that may be similar, only say which classes make up a
    family. A family's answers are derived from those of its cheapest set
    and the differences to a centre (``derived_links``), so a large group of
    near copies yields no pairs of its members.

    A text without words, empty or null, has an empty set and is its own
    component. ``component_id`` is the least doc_id of the component, nulls
    left out; it is null if there is none. Repeated rows belong together.
    Other columns are ignored; no rows give no rows.
    """
    sets, named = linked_sets(docs.select("doc_id", "text"), width, percent)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    rows = sets.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component: of its least doc_id, nulls last, the least text.

    Of rows equal in both, any one. Rows without words all stay.
    """
    since = len(SETTLED)
    sets, named = linked_sets(docs.select("doc_id", "text"), width, percent)
    first = "min(struct(doc_id is null as last, doc_id, code)) as first"
    members = sets.select("doc_id", "code", "digest").join(named.select("digest", "component"), "digest")
    kept = members.groupBy("component").agg(F.expr(first)).selectExpr("struct(first.doc_id) as _id", "first.code as _code")
    kept = settle(kept, "kept")
    keep_settled(docs.sparkSession, since, SETTLED[-1:])
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Null ids are equal inside a struct. Rows join and meet their copies by the same key, so texts are dealt once.
    keyed = docs.where(worded).withColumns({"_id": F.struct("doc_id"), "_code": F.xxhash64("text")})
    once = keyed.join(kept, ["_id", "_code"]).dropDuplicates(["_id", "_code"])
    return once.select(*docs.columns).unionByName(docs.where(~worded))
