"""Mine collocations shard by shard (SON), then count all candidates exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeflow.llm.memory import returning_memory
from fringeflow.llm.shingles import WordHasher, mixed
from fringeflow.sources.stage_store import settle

SHARDS = 4
# Bits of the filter that stands for a set of hashed phrases: 16 MB, whatever the input.
FILTER_BITS = 27
# Characters of text looked at together, unless one text is longer; counts a task holds before it passes them on.
HELD_CHARS = 1 << 20
HELD_HASHES = 1 << 20
HELD_PHRASES = 1 << 18
# Parts of a language that are ranked by themselves first.
RANK_PARTS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, dtype=np.int8)
_KIND[list(b" \t")] = 1
_KIND[list(_BREAKS)] = 2
_AS_SPACE = bytes(32 if kind else byte for byte, kind in enumerate(_KIND))
_STEP = np.uint64(0x9E3779B97F4A7C15)

Batches = Iterator[pa.RecordBatch]


def stretches(batches: Batches) -> Iterator[tuple[str, bytes]]:
    """Language and joined texts, lower-cased in A-Z; texts are separate pieces."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang.setdefault(lang, []).append(text or "")
        for lang, texts in by_lang.items():
            held, size = [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size > HELD_CHARS:
                    yield lang, "\n".join(held).encode("utf-8", "surrogatepass").lower()
                    held, size = [], 0
            if held:
                yield lang, "\n".join(held).encode("utf-8", "surrogatepass").lower()


def split_words(data: bytes) -> list[bytes]:
    return data.translate(_AS_SPACE).split()


class PhraseHasher:
    """64-bit hashes of all phrases of a stretch of text, by language."""

    def __init__(self) -> None:
        self.words = WordHasher()

    def hashes(self, lang: str, data: bytes, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For phrases of 1 to ``size`` words starting at each word: hashes, and whether they lie in one piece."""
        array = np.frombuffer(data, dtype=np.uint8)
        kind = _KIND[array]
        inside = np.r_[False, kind == 0, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
        hashed = [mixed(self.words.spans(array, starts, ends) ^ self.of_lang(lang))]
        whole = [np.ones(len(starts), dtype=bool)]
        for more in range(1, size):
            n = max(0, len(starts) - more)
            hashed.append(mixed(hashed[-1][:n] * _STEP + hashed[0][more:]))
            whole.append(piece[:n] == piece[more:])
        return hashed, whole

    def of_lang(self, lang: str) -> np.uint64:
        data = np.frombuffer(lang.encode() + b"\0", dtype=np.uint8)
        return self.words.spans(data, np.array([0]), np.array([len(data)]))[0]


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def hash_filter(hashes: DataFrame) -> Broadcast:
    """The leading bits of all values of column ``hash`` as a bitmap of ``2**FILTER_BITS`` bits, for all tasks.

    Tasks combine its words; at most ``2**FILTER_BITS / 64`` of them reach
    the driver, however many hashes there are.
    """
    at = f"shiftrightunsigned(hash, {64 - FILTER_BITS})"
    words = hashes.selectExpr(f"{at} div 64 as place", f"shiftleft(1L, cast({at} % 64 as int)) as bit")
    combined = words.groupBy("place").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bitmap[combined["place"].to_numpy()] = combined["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def _count_words(shards: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counts: dict[str, Counter] = {}
        for lang, data in stretches(batches):
            counts.setdefault(lang, Counter()).update(split_words(data))
            if sum(map(len, counts.values())) > HELD_PHRASES:
                yield from _counted(counts, shards)
        yield from _counted(counts, shards)

    return run


def _counted(counts: dict[str, Counter], shards: int) -> Batches:
    shard = TaskContext.get().partitionId() % shards
    for lang, found in counts.items():
        columns = [
            pa.array([shard] * len(found), pa.int32()),
            pa.array([lang] * len(found), pa.string()),
            pa.array([p.decode("utf-8", "surrogatepass") for p in found], pa.string()),
            pa.array(list(found.values()), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "phrase", "a"])
    counts.clear()


def _hash_words(batches: Batches) -> Batches:
    hasher = PhraseHasher()
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            by_lang.setdefault(lang, []).append(word)
        for lang, words in by_lang.items():
            hashes = hasher.hashes(lang, "\n".join(words).encode("utf-8", "surrogatepass"), 1)[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])


def _mine_shard(size: int, shards: int, shorter: Broadcast) -> Callable[[Batches], Batches]:
    """Counts of the hashed phrases of ``size`` words, both of whose parts of one word less pass ``shorter``."""

    def run(batches: Batches) -> Batches:
        hasher, bitmap = PhraseHasher(), shorter.value
        shard = TaskContext.get().partitionId() % shards
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        parts: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(parts) if parts else keys[:0], return_counts=True)
            both, at = np.unique(np.r_[keys, new], return_inverse=True)
            return both, np.bincount(at, np.r_[counts, n], len(both)).astype(np.int64)

        def emitted() -> Batches:
            for start in range(0, len(keys), 1 << 16):
                cut = slice(start, start + (1 << 16))
                values = keys[cut].view(np.int64), counts[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values[0]), shard, dtype=np.int32)), *map(pa.array, values)], ["shard", "hash", "n"]
                )

        for lang, data in stretches(batches):
            hashed, whole = hasher.hashes(lang, data, size)
            often = passes(bitmap, hashed[size - 2])
            n = len(hashed[-1])
            parts.append(hashed[-1][whole[-1] & often[:n] & often[1 : n + 1]])
            if sum(map(len, parts)) > HELD_HASHES:
                keys, counts = merged()
                parts = []
                if len(keys) > HELD_HASHES:
                    yield from emitted()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield from emitted()

    return run


def _count_candidates(shards: int, candidates: dict[int, Broadcast]) -> Callable[[Batches], Batches]:
    """Counts of the phrases themselves that pass the filter of their number of words."""

    def run(batches: Batches) -> Batches:
        hasher = PhraseHasher()
        counts: dict[str, Counter] = {}
        for lang, data in stretches(batches):
            words = split_words(data)
            hashed, whole = hasher.hashes(lang, data, max(candidates))
            found = counts.setdefault(lang, Counter())
            for size, allowed in candidates.items():
                at = np.flatnonzero(whole[size - 1] & passes(allowed.value, hashed[size - 1]))
                found.update(b" ".join(words[i : i + size]) for i in at.tolist())
            if sum(map(len, counts.values())) > HELD_PHRASES:
                yield from _counted(counts, shards)
        yield from _counted(counts, shards)

    return run


COUNTED = "shard int, lang string, phrase string, a long"


def _locally_frequent(mined: DataFrame, supports: dict[int, int], min_count: int) -> DataFrame:
    """Hashes that reach some shard's support, less those that all shards together do not bring to ``min_count``.

    The counts of all shards come together in one row, so the sum costs no
    further shuffle. Phrases that share a hash only make it larger.
    """
    found = [F.sum(F.when(F.col("shard") == s, F.col("n"))).alias(f"n{s}") for s in supports]
    counts = mined.groupBy("hash").agg(*found, F.sum("n").alias("n"))
    local = " or ".join(f"n{s} >= {least}" for s, least in supports.items()) or "false"
    return counts.where(f"({local}) and n >= {min_count}").select("hash")


def frequent_phrases(docs: DataFrame, max_words: int, min_count: int, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Words and phrases of ``docs(text, lang)`` found at least ``min_count`` times, and the words of each language.

    The first has ``lang, phrase, size, a``, the second ``lang, n``. Tasks
    are dealt to ``shards`` shards. A shard that holds a share of all words
    is mined at that share of ``min_count``, rounded up: a phrase rarer than
    that in every shard is rarer than ``min_count`` in all. Each shard is
    mined level by level, as a phrase is no more frequent than its parts.
    What is frequent in any shard, and by its hash in all, is then counted in
    all texts by its words. Hashes only ever add candidates.
    """
    texts = docs.selectExpr("text", "coalesce(lang, 'und') as lang")
    parts = settle(texts.mapInArrow(returning_memory(_count_words(shards)), COUNTED), "word_counts")
    words = parts.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    langs = parts.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = settle(words.where(f"a >= {min_count}"), "words")
    sizes = {r.shard: r.n for r in parts.groupBy("shard").agg(F.sum("a").alias("n")).collect()}
    total = sum(sizes.values())
    supports = {shard: -(-min_count * n // total) for shard, n in sizes.items() if n}
    shorter = hash_filter(frequent.select("lang", "phrase").mapInArrow(returning_memory(_hash_words), "hash long"))
    candidates = {}
    for size in range(2, max_words + 1):
        mined = texts.mapInArrow(returning_memory(_mine_shard(size, shards, shorter)), "shard int, hash long, n long")
        shorter = candidates[size] = hash_filter(_locally_frequent(mined, supports, min_count))
    counted = texts.mapInArrow(returning_memory(_count_candidates(shards, candidates)), COUNTED)
    phrases = counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(f"a >= {min_count}")
    both = frequent.unionByName(phrases).selectExpr("lang", "phrase", "size(split(phrase, ' ')) as size", "a")
    return settle(both, "phrases"), langs


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of phrases of two words or more, by their weakest cut.

    A cut's score is ``floor(1000000 * a * a / (l * r))``, in decimals of 38
    digits; of equal ones the first cut counts.
    """
    words = phrases.where("size > 1").selectExpr("lang", "phrase", "size", "a", "split(phrase, ' ') as words")
    cuts = words.selectExpr("*", "explode(sequence(1, size - 1)) as k")
    cuts = cuts.selectExpr(
        *("lang", "phrase", "size", "a", "k"),
        "array_join(slice(words, 1, k), ' ') as head",
        "array_join(slice(words, k + 1, size - k), ' ') as tail",
    )
    counts = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(counts.toDF("lang", "head", "l"), ["lang", "head"]).join(counts.toDF("lang", "tail", "r"), ["lang", "tail"])
    wide = "cast({} as decimal(18,0))".format
    score = f"cast(1000000 * ({wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')}) as long)"
    weakest = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(weakest).selectExpr("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def uncovered(rows: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """``rows`` whose words lie in no longer phrase with at least ``percent`` of their count."""
    words = phrases.where("size > 2").selectExpr("lang", "a", "size", "split(phrase, ' ') as words")
    inner = words.selectExpr("*", "explode(sequence(2, size - 1)) as part").selectExpr("*", "explode(sequence(1, size - part + 1)) as at")
    inner = inner.selectExpr("lang", "array_join(slice(words, at, part), ' ') as phrase", "a")
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = rows.join(covers, ["lang", "phrase"], "left")
    return joined.where(f"longer is null or 100 * longer < {percent} * a").drop("longer")


def collocations(
    docs: DataFrame, max_words: int, min_count: int, percent: int, first: int, shards: int = SHARDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of each language of ``docs(text, lang)``.

    Texts are lower-cased in A-Z and split at ``.,;:!?`` and line ends into
    pieces, those at blanks and tabs into words; a null language is ``und``.
    Candidates are phrases of 2 to ``max_words`` words found at least
    ``min_count`` times, without those that ``percent`` of their count lies
    in a longer candidate. They rank by score, count and phrase.

    Null and empty texts have no words, repeated rows count one by one, other
    columns are ignored, and no rows give no rows.
    """
    phrases, langs = frequent_phrases(docs, max_words, min_count, shards)
    rows = uncovered(scored(phrases), phrases, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = rows.withColumn("part", F.expr(f"pmod(xxhash64(phrase), {RANK_PARTS})"))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(f"rank <= {first}").drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(f"rank <= {first}").join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
