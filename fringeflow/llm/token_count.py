"""Count the tokens of texts under a byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fringeflow.llm.memory import returning_memory

# Pre-tokens whose counts a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 20
# Characters of text whose pre-tokens are held at once, unless one text is longer.
HELD_CHARS = 1 << 20

# The splitting pattern of this tokenizer kind. White space is
# spelt out, as regular expression engines differ over control characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class MergeTable:
    """Merges of a vocabulary as sorted arrays: pair of symbols -> rank and product."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model, added = spec["model"], spec["added_tokens"]
        step = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and step.get("type") == "ByteLevel" and not step["add_prefix_space"]
        odd = [model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if not plain or model["type"] != "BPE" or any(odd) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("not a plain byte-level BPE definition")
        vocab = model["vocab"]
        self.special = [t["content"] for t in added]
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        self.product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, -1)

    def surviving(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair of its own can be merged.

        All pre-tokens lie end to end in one array. In each round every
        pre-token that still has a pair merges its lowest-ranked one, at all
        its places from the left, at the same time as the others do.
        """
        sizes = np.array([len(p) for p in pretokens], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), sizes)
        counts = sizes.copy()
        none = len(self.key)
        while len(symbols) > 1:
            at = self.find(symbols[:-1], symbols[1:])
            at[owner[:-1] != owner[1:]] = -1
            rank = np.where(at >= 0, self.rank[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            alive = lowest < none
            if not alive.any():
                break
            lengths = np.diff(np.r_[starts, len(symbols)])
            merge = np.r_[(rank == np.repeat(lowest, lengths)[:-1]) & (rank < none), False]
            # Of overlapping places (a a a), every second one of a run from its left end.
            place = np.arange(len(merge))
            run_start = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], place, 0))
            merge &= (place - run_start) % 2 == 0
            symbols[merge] = self.product[at[merge[:-1]]]
            keep = ~np.r_[False, merge[:-1]]
            # Pre-tokens with nothing to merge are done and leave the array.
            counts[owner[starts[~alive]]] = lengths[~alive]
            keep &= np.repeat(alive, lengths)
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            left, lengths = np.unique(owner, return_counts=True)
            counts[left] = lengths
        return counts


def count_batches(definition: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = MergeTable(definition)
        split = regex.compile(SPLIT).findall
        special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) or r"(?!)")
        known: dict[str, int] = {}

        def counted(texts: list[str]) -> list[int]:
            found = [[p for part in special.split(t) for p in split(part)] for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*found).difference(known))
            if new:
                known.update(zip(new, table.surviving([p.encode() for p in new]).tolist()))
            extra = [len(special.findall(t)) for t in texts]
            return [sum(map(known.__getitem__, f)) + e for f, e in zip(found, extra)]

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, held, size = [], [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size > HELD_CHARS:
                    counts += counted(held)
                    held, size = [], 0
            counts += counted(held)
            n_tokens = pa.array(counts, pa.int64())
            columns = [
                batch.column("doc_id"),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                n_tokens,
                pa.array([n > limit for n in counts], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    ``tokenizer`` is the path of a byte-level BPE definition; the driver
    reads it, so executors need no copy. Strings of added tokens inside a
    text count as one token each.

    Distinct pre-tokens of a stretch of text are merged together as ragged
    arrays (``MergeTable.surviving``) and remembered, within bounds, for the
    rest of the task. A null or empty text has no tokens. Repeated rows are
    counted one by one; other columns are ignored; no rows give no rows.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(returning_memory(count_batches(definition, limit)), schema)
