"""Remove bytes of texts that lie in a long string found more than once in the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fringeflow.llm.matching import rows_with_keys
from fringeflow.llm.memory import returning_memory
from fringeflow.llm.shingles import mixed
from fringeflow.sources.stage_store import settle

# Bytes of the strings whose smallest hash picks the sampled suffixes.
SAMPLE_BYTES = 32
# Windows of a text that are worked on at once; also bounds places within them.
SEGMENT = 1 << 19
# Sampled suffixes sorted at once, and surroundings of one sample that may meet in one task.
SORTED_ROWS = 1 << 14
VARIANTS = 1 << 14

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

Batches = Iterator[pa.RecordBatch]
LIST = "array<struct<anchor:long,many:boolean,span:long>>"


class RollingHash:
    """Hashes of substrings of bytes, by running sums."""

    def __init__(self, size: int) -> None:
        self.powers, self.inverses = (
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, base, dtype=np.uint64)])
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        )

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverses[start]


def smallest_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    span, least = 1, keys
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def pack_span(at: np.ndarray, reach: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window, bytes from there to the sample, and number of windows in one number."""
    return at << 16 | reach << 8 | count


def unpack_span(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 16, span >> 8 & 255, span & 255


def sample_batches(length: int) -> Callable[[Batches], Batches]:
    """Sampled suffixes of each text with the windows that hang on them.

    Of the short strings in a window the one with the least hash is its
    sample, the first if there are several, so equal windows have equal
    samples at equal places. Windows in a row with one sample make a context.
    """
    choices = length - SAMPLE_BYTES + 1
    place_mask = np.uint64((1 << 20) - 1)

    def run(batches: Batches) -> Batches:
        rolling = RollingHash(SEGMENT + length)
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                whole = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for low in range(0, len(whole) - length + 1, SEGMENT):
                    data = whole[low : low + SEGMENT + length - 1]
                    sums = rolling.sums(data)
                    places = np.arange(len(data) - SAMPLE_BYTES + 1)
                    codes = mixed(rolling.between(sums, places, places + SAMPLE_BYTES))
                    keys = codes & ~place_mask | places.astype(np.uint64)
                    sample = (smallest_in_windows(keys, choices) & place_mask).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])
                    last = np.r_[first[1:], len(sample)] - 1
                    sample = sample[first]
                    context = rolling.between(sums, first, last + length) + (last - first).astype(np.uint64)
                    span = pack_span(first + low, sample - first, last - first + 1)
                    parts.append((codes[sample], mixed(context), np.full(len(first), row), span))
            if parts:
                anchor, context, row, span = (np.concatenate(x) for x in zip(*parts))
                owner = pa.array(row)
                columns = [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))]
                columns += [batch.column(c).take(owner) for c in ("ref", "size")] + [pa.array(span)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "context", "ref", "size", "span"])

    return run


def context_batches(length: int) -> Callable[[Batches], Batches]:
    """Bytes of the contexts listed for each text."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows, cut = [], []
            for row, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                data = text.encode("utf-8", "surrogatepass")
                for item in wanted:
                    at, count = item["span"] >> 16, item["span"] & 255
                    rows.append((row, item["anchor"], item["many"], item["span"]))
                    cut.append(data[at : at + count + length - 1])
            row, anchor, many, span = zip(*rows) if rows else ((),) * 4
            owner = pa.array(row, pa.int64())
            columns = [pa.array(anchor, pa.int64()), pa.array(many, pa.bool_())]
            columns += [batch.column(c).take(owner) for c in ("ref", "size")]
            columns += [pa.array(span, pa.int64()), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "many", "ref", "size", "span", "bytes"])

    return run


def padded(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width)


def sorted_with_prefixes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte strings, and how much each shares with the one before it in that order."""
    order = np.argsort(np.ascontiguousarray(strings).view(f"V{strings.shape[1]}").ravel(), kind="stable")
    ranked = strings[order]
    differs = ranked[1:] != ranked[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    return order, np.r_[0, common]


def repeated_windows(anchor: np.ndarray, reach: np.ndarray, count: np.ndarray, rows: list[bytes], length: int) -> np.ndarray:
    """For each context and place of the sample in a window: whether another context of the sample has that window.

    Suffixes from the samples on are sorted with their common prefixes, and so
    are the strings before the samples, read backwards. A window with the
    sample at place ``p`` equals another if the suffixes share ``length - p``
    bytes and the strings before it ``p``. Both kinds of classes follow from
    the common prefixes, place by place, without looking at bytes again.
    """
    widest = int(reach.max(initial=0)) + 1
    name = anchor.astype(">i8").view(np.uint8).reshape(-1, 8)
    after = padded([r[k:] for r, k in zip(rows, reach.tolist())], length)
    before = padded([r[:k][::-1] for r, k in zip(rows, reach.tolist())], widest)
    after_order, after_common = sorted_with_prefixes(np.concatenate([name, after], axis=1))
    before_order, before_common = sorted_with_prefixes(np.concatenate([name, before], axis=1))
    found = np.zeros((len(rows), widest), dtype=bool)
    after_class, before_class = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for place in range(widest):
        has = np.flatnonzero((place <= reach) & (place > reach - count))
        if len(has) < 2:
            continue
        after_class[after_order] = np.cumsum(after_common < 8 + length - place)
        before_class[before_order] = np.cumsum(before_common < 8 + place)
        both = after_class[has] * len(rows) + before_class[has]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        found[has[order[np.r_[same, False] | np.r_[False, same]]], place] = True
    return found


def judge_batches(length: int) -> Callable[[Batches], Batches]:
    """Runs of repeated windows in contexts that were seen once; input is sorted by anchor."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        anchor, span, many = (table.column(c).to_numpy() for c in ("anchor", "span", "many"))
        at, reach, count = unpack_span(span)
        found = repeated_windows(anchor, reach, count, table.column("bytes").to_pylist(), length)
        found[many.astype(bool)] = False
        # Window w of a context has the sample at place reach - w.
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        owner = pa.array(row)
        columns = [table.column(c).combine_chunks().take(owner) for c in ("ref", "size")]
        columns += [pa.array(at[row] + reach[row] - high + 1), pa.array(at[row] + reach[row] - low)]
        return pa.RecordBatch.from_arrays(columns, ["ref", "size", "first", "last"])

    def run(batches: Batches) -> Batches:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held else table
            if len(held) >= SORTED_ROWS:
                anchor = held.column("anchor").to_numpy()
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if cut:
                    yield judged(held.slice(0, cut))
                    held = held.slice(cut)
        if held:
            yield judged(held)

    return run


def window_batches(length: int) -> Callable[[Batches], Batches]:
    """A hash for each window of each context."""

    def run(batches: Batches) -> Batches:
        rolling = RollingHash(2 * length)
        for batch in batches:
            at, _, count = unpack_span(batch.column("span").to_numpy())
            codes = []
            for data in batch.column("bytes").to_pylist():
                sums = rolling.sums(np.frombuffer(data, dtype=np.uint8))
                start = np.arange(len(data) - length + 1)
                codes.append(mixed(rolling.between(sums, start, start + length)))
            row = np.repeat(np.arange(len(at)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            columns = [batch.column(c).take(pa.array(row)) for c in ("many", "ref", "size")]
            columns += [pa.array(at[row] + place), pa.array(np.concatenate(codes).view(np.int64) if codes else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["many", "ref", "size", "first", "code"])

    return run


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Adds ``ref`` and ``size``, which together name a text; null texts become empty."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("ref", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long"))


def repeated_runs(docs: DataFrame, length: int, variants: int = VARIANTS) -> DataFrame:
    """``ref, size, runs(first, last)``: for each text with repeated windows of ``length`` bytes, where these start.

    Sampled suffixes stand for all: their contexts are counted, and what
    holds for a context is induced for all windows on it. A context seen
    twice has only repeated windows. One seen once, whose sample occurs in
    other contexts, is compared with those by sorting the sampled suffixes
    with their common prefixes. A sample alone has none. A sample with more
    than ``variants`` contexts has its windows counted by hash instead, so
    that no task must hold them.
    """
    texts = keyed_texts(docs).select("ref", "size", "text")
    spec = "anchor long, context long, ref long, size long, span long"
    samples = texts.where(f"size >= {length}").mapInArrow(returning_memory(sample_batches(length)), spec)
    twice = samples.groupBy("anchor").count().where("count > 1").select("anchor")
    candidates = settle(samples.join(twice, "anchor"), "candidates")
    contexts = candidates.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("ref", "size", "span")).alias("one")
    )
    contexts = settle(contexts, "contexts")
    whole = candidates.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    whole = whole.selectExpr("ref", "size", "span >> 16 as first", "(span >> 16) + (span & 255) - 1 as last").distinct()

    kinds = contexts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    kinds = kinds.where("kinds > 1 and fewest = 1")
    unsure = contexts.join(kinds, "anchor").selectExpr("anchor", "n > 1 as many", "one.*", "kinds")
    unsure = settle(unsure, "unsure")
    wanted = unsure.groupBy("ref", "size").agg(F.collect_list(F.struct("anchor", "many", "span")).alias("wanted"))
    single = rows_with_keys(texts, unsure, ["ref", "size"]).groupBy("ref", "size").agg(F.any_value("text").alias("text"))
    spec = "anchor long, many boolean, ref long, size long, span long, bytes binary"
    cut = single.join(wanted, ["ref", "size"]).select("ref", "size", "text", "wanted")
    cut = cut.mapInArrow(returning_memory(context_batches(length)), spec)
    large = kinds.where(f"kinds > {variants}").select("anchor")
    cut = settle(cut, "cut")
    spec = "ref long, size long, first long, last long"
    few = cut.join(large, "anchor", "left_anti").select(cut.columns)
    few = few.repartition("anchor").sortWithinPartitions("anchor")
    judged = few.mapInArrow(returning_memory(judge_batches(length)), spec)

    spec = "many boolean, ref long, size long, first long, code long"
    windows = cut.join(large, "anchor", "left_semi").select(cut.columns).mapInArrow(window_batches(length), spec)
    windows = settle(windows, "windows")
    again = windows.groupBy("code").count().where("count > 1").select("code")
    counted = windows.where("not many").join(again, "code").selectExpr("ref", "size", "first", "first as last")
    runs = whole.unionByName(judged).unionByName(counted)
    return runs.groupBy("ref", "size").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def cut_runs(data: bytes, runs: list[dict[str, int]], length: int) -> tuple[list[bytes], int]:
    """Parts of a text left between the bytes covered by windows, and the number of maximal covered runs."""
    kept, end, spans = [], 0, 0
    for first, last in sorted((r["first"], r["last"]) for r in runs):
        if first > end or not spans:
            kept.append(data[end:first])
            spans += 1
        end = max(end, last + length)
    kept.append(data[end:])
    return kept, spans


def remove_repeats(docs: DataFrame, length: int, variants: int = VARIANTS, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``kept, n_bytes, n_removed, n_spans`` for every row.

    Texts are UTF-8 bytes. Each byte goes that lies in a string of ``length``
    bytes which also starts anywhere else in the table, in the same text or
    another; strings are judged on the input and never cross texts. ``kept``
    holds the remaining bytes in a row, as binary, since a cut may fall inside
    a character; with ``as_text`` it is a string without characters cut in
    two. ``n_spans`` counts maximal removed runs.

    A null text is empty; texts under ``length`` bytes stay whole. Repeated
    rows repeat each other and go. Columns of ``docs`` named like the results
    are replaced; no rows give no rows.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    runs = settle(repeated_runs(docs, length, variants), "runs")
    runs = runs.selectExpr("ref as _ref", "size as _size", "runs as _runs")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    joined = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("n_bytes", size)
    joined = joined.join(runs, (F.col("_key") == F.col("_ref")) & (F.col("n_bytes") == F.col("_size")), "left")
    joined = joined.select(*docs.columns, "n_bytes", "_runs")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            left, removed, spans = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                parts, count = cut_runs(data, found, length) if found else ([data], 0)
                left.append(b"".join(parts))
                removed.append(len(data) - len(left[-1]))
                spans.append(count)
            kept = pa.array([x.decode("utf-8", "ignore") for x in left]) if as_text else pa.array(left, pa.binary())
            columns = [*batch.columns[:-1], kept, pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "kept", "n_removed", "n_spans"])

    schema = StructType([*docs.schema.fields]).add("n_bytes", "long").add("kept", "string" if as_text else "binary")
    return joined.mapInArrow(returning_memory(cut), schema.add("n_removed", "long").add("n_spans", "long"))


def drop_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; null texts and all other columns stay as they are."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in _INNER}
    cleaned = remove_repeats(docs.withColumnsRenamed(aside), length, as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept")).alias("text")
    return cleaned.select(*[text if c == "text" else F.col(aside.get(c, c)).alias(c) for c in docs.columns])


# Columns that ``remove_repeats`` makes.
_INNER = {"kept", "n_bytes", "n_removed", "n_spans", "_key", "_ref", "_size", "_runs"}
