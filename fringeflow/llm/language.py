"""Predict languages with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fringeflow.llm.memory import returning_memory
from fringeflow.sources.stage_store import settle

DIMENSIONS = 1024
# Letters share this many vectors, by code point; all of Latin has its own.
SYMBOLS = 1024
GRAM = 3
# Documents compared with the prototypes at once, and trigram vectors kept by a task.
BLOCK = 256
KEPT_VECTORS = 1 << 15

UNKNOWN = "und"

# A text of so many characters is in none of the languages below this cosine.
SURE_CHARS = 200
FOREIGN = 0.15


def letter_codes(text: str) -> np.ndarray:
    """Symbols of a text: one for each letter, 0 for each run of other characters, and one 0 at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _letters()
    low = points < len(table)
    letter = np.zeros(len(points), dtype=bool)
    letter[low] = table[points[low]]
    if not low.all():
        letter[~low] = [chr(p).isalpha() for p in points[~low]]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.where(letter, 1 + points % (SYMBOLS - 1), 0).astype(np.int64)
    codes = np.r_[0, codes, 0]
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(p).isalpha() for p in range(0x3000)]))
    return _LETTERS[0]


_LETTERS: list[np.ndarray] = []


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, trigram and count of all distinct trigrams of each text."""
    rows, grams = [], []
    for row, text in enumerate(texts):
        codes = letter_codes(text or "")
        if len(codes) >= GRAM:
            rows.append(np.full(len(codes) - 2, row))
            grams.append((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:])
    if not rows:
        return (np.zeros(0, dtype=np.int64),) * 3
    both, counts = np.unique(np.concatenate(rows) << 32 | np.concatenate(grams), return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, counts


def letter_vectors() -> np.ndarray:
    """A random vector of -1 and 1 for each symbol, the same in every process."""
    return np.random.default_rng(20240101).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))


class TrigramVectors:
    """Trigram vectors: the three letter vectors, rotated by their place, multiplied."""

    def __init__(self) -> None:
        last = letter_vectors()
        self.places = np.roll(last, 2, axis=1), np.roll(last, 1, axis=1), last
        self.known = np.zeros(0, dtype=np.int64)
        self.vectors = np.zeros((0, DIMENSIONS), dtype=np.int8)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        first, second, third = self.places
        return first[grams // SYMBOLS**2] * second[grams // SYMBOLS % SYMBOLS] * third[grams % SYMBOLS]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct trigrams."""
        if len(self.known) > KEPT_VECTORS:
            self.known, self.vectors = self.known[:0], self.vectors[:0]
        new = np.setdiff1d(grams, self.known, assume_unique=True)
        if len(new):
            order = np.argsort(both := np.r_[self.known, new])
            self.known, self.vectors = both[order], np.concatenate([self.vectors, self.bind(new)])[order]
        return self.vectors[np.searchsorted(self.known, grams)].astype(np.float32)


def bundle(texts: list[str | None], vectors: TrigramVectors) -> np.ndarray:
    """Sum of the trigram vectors of each text."""
    rows, grams, counts = trigrams(texts)
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    distinct, column = np.unique(grams, return_inverse=True)
    for start in range(0, len(distinct), 4096):
        part = distinct[start : start + 4096]
        here = (column >= start) & (column < start + 4096)
        weights = np.zeros((len(texts), len(part)), dtype=np.float32)
        weights[rows[here], column[here] - start] = counts[here]
        out += weights @ vectors.of(part)
    return out


def is_held_out(doc_id: Column) -> Column:
    """One document in four, by the checksum of its id; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def language_profiles(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language in ``labelled(text, lang)``: the sum of all its trigram vectors.

    Tasks count trigrams by language; by linearity their weighted sum is the
    sum over all texts. What reaches the driver has at most ``DIMENSIONS``
    numbers for each language. Rows without language or letters add nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = TrigramVectors()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for start in range(0, len(own), BLOCK):
                    _, grams, counts = trigrams(own[start : start + BLOCK])
                    distinct, at = np.unique(grams, return_inverse=True)
                    total = np.bincount(at, counts, len(distinct))
                    for cut in range(0, len(distinct), 4096):
                        part = total[cut : cut + 4096].astype(np.float64) @ vectors.of(distinct[cut : cut + 4096])
                        sums[lang] = sums.get(lang, 0) + part
        for lang, total in sums.items():
            whole = np.rint(total).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(whole)],
                ["lang", "at", "value"],
            )

    rows = labelled.where("lang is not null").select("text", "lang").mapInArrow(
        returning_memory(count), "lang string, at int, value long"
    )
    sums = rows.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    profiles: dict[str, np.ndarray] = {}
    for row in settle(sums, "profiles").toLocalIterator():
        profiles.setdefault(row.lang, np.zeros(DIMENSIONS))[row.at] = row.value
    return {lang: p / norm for lang, p in sorted(profiles.items()) if (norm := np.linalg.norm(p)) > 0}


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` for every row, from its text alone.

    The whole text becomes the sum of its trigram vectors, and the language
    with the greatest cosine wins; of equal ones the first by name. ``score``
    is that cosine, at least 0. A null text, one without a letter, or no
    profile at all gives ``und`` and 0. Columns of ``docs`` named like the
    results are replaced. Repeated rows are judged one by one; no rows give
    no rows.
    """
    docs = docs.drop("lang_pred", "score")
    langs = list(profiles)
    prototypes = np.array([profiles[x] for x in langs], dtype=np.float32).reshape(len(langs), DIMENSIONS)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = TrigramVectors()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, scores = [], []
            for start in range(0, len(texts), BLOCK):
                sums = bundle(texts[start : start + BLOCK], vectors)
                norms = np.linalg.norm(sums, axis=1)
                if not langs:
                    norms[:] = 0
                cosines = sums @ prototypes.T / np.maximum(norms, 1)[:, None] if langs else np.zeros((len(sums), 1))
                best = cosines.argmax(axis=1)
                found += [langs[b] if n > 0 else UNKNOWN for b, n in zip(best, norms)]
                scores += np.where(norms > 0, cosines.max(axis=1).clip(0, 1), 0).astype(np.float64).tolist()
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(returning_memory(predict), schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``; learns from rows not held out."""
    profiles = language_profiles(docs.where(~is_held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return predict_languages(rows, profiles).drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without rows in no known language; learns from rows not held out.

    Rows of language ``und`` go, and texts of at least 200 characters whose
    cosine with every profile is under 0.15. Short texts are never judged by
    their cosine.
    """
    profiles = language_profiles(docs.where(~is_held_out(F.col("doc_id"))))
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    judged = predict_languages(docs.withColumnsRenamed(aside), profiles)
    foreign = (F.length("text") >= SURE_CHARS) & (F.col("score") < FOREIGN)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & ~foreign)
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
