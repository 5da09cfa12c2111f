"""Pack token sequences into windows of fixed size by patterns of few documents."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fringeflow.llm.memory import returning_memory
from fringeflow.llm.shingles import WordHasher
from fringeflow.sources.stage_store import settle

# Ends a document.
END_ID = 0
# Words whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 18
# Characters worked on at once, unless one text is longer.
BLOCK_CHARS = 1 << 20
# Second lengths tried with each first one in patterns of three.
SECOND_LENGTHS = 12
FIT_STEPS = 200

# Texts of these characters are the same under NFC, lower-cased letter by
# letter and split alike by all regular expression engines. Apostrophes are
# left out, as contractions are split by rules of their own.
PLAIN = re.compile(r"[\t\n\r -&(-~¡-ÿ]*")
# Fixed value: the splitting pattern of this tokenizer kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_FORMS = ["NFC", "Replace", "Lowercase"]
WORD_END = "</w>"


class WordIds:
    """Ids of texts. Words of plain texts are looked up by hash; all else goes through the library."""

    def __init__(self, definition: str) -> None:
        self.library = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        forms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = steps[0].get("pattern") == {"Regex": WORDS} and forms == NORMAL_FORMS and suffix == WORD_END
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for word, i in spec["model"]["vocab"].items() if word.endswith(WORD_END)]] = True
        letters = [chr(i) for i in range(256)]
        self.lower = bytes(ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < 256 else ord(c) for c in letters)
        kinds = [r"\s", r"\p{L}", r"\p{N}"]
        # 0 space, 1 letter, 2 number, 3 other.
        self.kind = np.array([next((k for k, p in enumerate(kinds) if regex.match(p, c)), 3) for c in letters], dtype=np.int8)
        self.hasher = WordHasher()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.start = self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words, all in one text: a word's last id is the only one that ends a word."""
        ids = self.encoded(" ".join(words))
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            raise ValueError("words and their ids do not match")
        start = np.r_[0, last[:-1]]
        order = np.argsort(known := np.r_[self.known, hashes])
        self.start = np.r_[self.start, start + len(self.ids)][order]
        self.count = np.r_[self.count, last - start][order]
        self.known, self.ids = known[order], np.r_[self.ids, ids]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        raw = "\n".join(texts).encode("latin-1").translate(self.lower)
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = self.kind[data]
        edges = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)] if len(kind) else [])
        ends = np.r_[edges[1:], len(data)]
        inside = kind[edges] != 0
        starts, ends = edges[inside], ends[inside]
        found, first, word = np.unique(self.hasher.spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, found)
        new = np.ones(len(found), dtype=bool)
        inner = at < len(self.known)
        new[inner] = self.known[at[inner]] != found[inner]
        if new.any():
            fresh = first[new]
            self._learn(found[new], [raw[s:e].decode("latin-1") for s, e in zip(starts[fresh], ends[fresh])])
        at = np.searchsorted(self.known, found)[word]
        counts = self.count[at]
        stops = np.cumsum(counts)
        ids = self.ids[np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.start[at] - stops + counts, counts)]
        # Ids up to the end of each text, a newline after which the next one starts.
        texts_end = np.cumsum([len(t) + 1 for t in texts])
        return np.split(ids, np.r_[0, stops][np.searchsorted(starts, texts_end)][:-1])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        quick = iter(self._plain([t for t, p in zip(texts, plain) if p]) if any(plain) else [])
        return [next(quick) if p else self.encoded(t) for t, p in zip(texts, plain)]


def cut_batches(definition: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(definition)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            rows, places, starts, lengths, sums = [], [], [], [], []
            held, size_held = [], 0
            texts = batch.column("text")
            for row in range(len(texts)):
                held.append(texts[row].as_py() or "")
                size_held += len(held[-1])
                if size_held < BLOCK_CHARS and row + 1 < len(texts):
                    continue
                for at, tokens in enumerate(ids.of(held), row + 1 - len(held)):
                    tokens = np.r_[tokens, end]
                    for piece, start in enumerate(range(0, len(tokens), size)):
                        part = tokens[start : start + size]
                        rows.append(at)
                        places.append(piece)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                held, size_held = [], 0
            columns = [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                batch.column("split").take(pa.array(rows, pa.int64())),
                pa.array(places, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "split", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """Pieces of at most ``size`` tokens of every document: ``doc_id, split, piece, start, length, ids_crc32``.

    ``split`` is the input split a piece comes from. The driver reads the
    tokenizer's definition, so executors need no copy.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, split int, piece int, start long, length long, ids_crc32 long"
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("split"))
    return rows.mapInArrow(returning_memory(cut_batches(definition, size)), schema)


@dataclass(frozen=True)
class Plan:
    """Packing of a histogram: each row gives ``count`` sequences the same documents' lengths."""

    patterns: list[tuple[tuple[int, ...], int]]

    def ranges(self) -> dict[str, np.ndarray]:
        """For each length, in order: the first rank, and the sequence and offset it goes to.

        Ranks number the pieces of a length from 0; ranks of one range fill
        successive sequences.
        """
        used: dict[int, int] = {}
        rows = []
        sequence = 0
        for lengths, count in self.patterns:
            offset = 0
            for length in lengths:
                rank = used.get(length, 0)
                rows.append((length, rank, sequence, offset))
                used[length] = rank + count
                offset += length
            sequence += count
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def few_document_patterns(histogram: np.ndarray) -> np.ndarray:
    """Patterns of one to three present lengths that fill a sequence as well as present lengths can; 0 for none."""
    size = len(histogram) - 1
    present = np.flatnonzero(histogram[1:]) + 1
    # Largest present length up to each value; 0 if there is none.
    fitting = np.zeros(size + 1, dtype=np.int64)
    fitting[present] = present
    fitting = np.maximum.accumulate(fitting)
    found = [np.stack([present, fitting[size - present], 0 * present], axis=1)]
    for step in range(SECOND_LENGTHS):
        rest = size - present
        second = fitting[rest - (rest * step) // (2 * SECOND_LENGTHS)]
        found.append(np.stack([present, second, fitting[rest - second]], axis=1))
    patterns = -np.sort(-np.concatenate(found), axis=1)
    return np.unique(patterns, axis=0)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern so that lengths are used up as they occur.

    There is an equation for each length, weighted by it, as short leftovers
    are easy to place, and one that asks for no unused space. Solved by
    accelerated projected gradient.
    """
    size = len(histogram) - 1
    weight = np.arange(size + 1) / size
    unused = 1 - weight[patterns].sum(axis=1)
    target = histogram * weight
    # Columns are scaled by the lengths they share with others, which evens out the step.
    uses = np.bincount(patterns.ravel(), minlength=size + 1)
    scale = 1 / np.sqrt((weight[patterns] ** 2 * uses[patterns]).sum(axis=1))

    def forward(x: np.ndarray) -> np.ndarray:
        used = np.bincount(patterns.ravel(), np.repeat(x * scale, patterns.shape[1]), size + 1) * weight
        used[0] = unused @ (x * scale)
        return used

    def backward(misses: np.ndarray) -> np.ndarray:
        return ((weight * misses)[patterns].sum(axis=1) + unused * misses[0]) * scale

    probe, bound = np.ones(len(patterns)), 1.0
    for _ in range(20):
        probe = backward(forward(probe / bound))
        bound = np.linalg.norm(probe)
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(z - backward(forward(z) - target) / (1.05 * bound), 0)
        if np.dot(z - new, new - x) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x * scale


def round_counts(patterns: np.ndarray, counts: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole counts that never use a length more often than it occurs; takes it out of ``histogram``."""
    chosen = []
    fill = patterns.sum(axis=1)
    for i in np.lexsort((-counts, -fill)):
        wanted = int(np.rint(counts[i]))
        if wanted <= 0:
            continue
        lengths = patterns[i][patterns[i] > 0]
        distinct, times = np.unique(lengths, return_counts=True)
        take = int(min(wanted, (histogram[distinct] // times).min()))
        if take > 0:
            histogram[distinct] -= take * times
            chosen.append((tuple(int(x) for x in lengths), take))
    return chosen


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack what a histogram holds, longest first, each into the fullest open sequences that take it."""
    size = len(histogram) - 1
    # Remaining space -> patterns with that space and how many sequences have them.
    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(size, 0, -1):
        left = int(histogram[length])
        placed: list[tuple[tuple[int, ...], int]] = []
        while left:
            space = min((s for s in spaces if s >= length), default=size)
            if not spaces.get(space):
                # Fresh sequences take as many of this length as fit.
                each = size // length
                if left >= each:
                    placed.append(((length,) * each, left // each))
                    left %= each
                else:
                    placed.append(((length,) * left, 1))
                    left = 0
                continue
            pattern, count = spaces[space].pop()
            if not spaces[space]:
                del spaces[space]
            each = min(space // length, max(1, left // count))
            take = min(count, left // each)
            if take < count:
                spaces.setdefault(space, []).append((pattern, count - take))
            grown = (pattern + (length,) * each, take)
            left -= take * each
            spaces.setdefault(space - length * each, []).append(grown)
        for pattern, count in placed:
            spaces.setdefault(size - sum(pattern), []).append((pattern, count))
    return [x for groups in spaces.values() for x in groups]


def pack_histogram(histogram: np.ndarray) -> Plan:
    """Fit patterns of few documents to a histogram of lengths, round, and pack what is left by best fit.

    ``histogram[n]`` is the number of pieces of ``n`` tokens. Cost and size
    of the plan depend on the sequence size, not on the number of pieces.
    """
    left = np.array(histogram, dtype=np.int64)
    if not left[1:].any():
        return Plan([])
    patterns = few_document_patterns(left)
    chosen = round_counts(patterns, fit_counts(patterns, left.astype(np.float64)), left)
    left[0] = 0
    return Plan(chosen + best_fit(left))


def place_batches(ranges: dict[str, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranks stay below 2**48, lengths below 2**15.
        starts = ranges["length"] * 2**48 + ranges["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, length * 2**48 + rank, side="right") - 1
            sequence = ranges["sequence"][at] + rank - ranges["rank"][at]
            kept = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(ranges["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of ``docs(doc_id, text)``.

    A document is its ids and an end id; longer ones than ``size`` are cut.
    Only the histogram of piece lengths, at most ``size`` rows, reaches the
    driver, which plans which lengths share a sequence. The pieces of a length
    are numbered by input split and then within it, and a number decides the
    sequence and offset, so no task sees all pieces of a length.

    A null or empty text is a piece of one token. Repeated rows are packed
    one by one; other columns are ignored; no rows give no rows.
    """
    pieces = settle(token_pieces(docs, tokenizer, size), "pieces")
    counts = settle(pieces.groupBy("length", "split").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    ranges = pack_histogram(histogram).ranges()

    starts = counts.selectExpr("length", "split", "sum(n) over (partition by length order by split) - n as before")
    within = "row_number() over (partition by length, split order by doc_id, piece, ids_crc32) - 1"
    ranked = pieces.selectExpr("*", f"{within} as within").join(starts, ["length", "split"])
    ranked = ranked.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "cast(before + within as long) as rank")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place_batches(ranges), schema)
