"""Quality rules over whole texts, and lines labelled by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.llm.memory import returning_memory

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
# A text of more words in repeated windows, in percent, fails; so does one of less content, in percent of its words.
REPEAT_PERCENT = 50
CONTENT_PERCENT = 50
WINDOW = 3

# Labelled documents to learn from at most, and how long they may be.
SAMPLE_LABELS = 4000
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
SAMPLE_LINES = 100
# Steps and strength of the fit.
STEPS = 150
RATE = 0.2
PENALTY = 1e-3

BOILERPLATE, CONTENT = 0, 1
FEATURES = (
    *("bias", "words", "chars_a_word", "symbols", "symbols_a_word", "digits", "upper", "marks", "high"),
    *("ends_sentence", "starts_upper", "address", "repeated", "empty"),
)

_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_CLASSES = {
    "symbols": np.isin(np.arange(256), list(SYMBOLS.encode())),
    "digits": np.isin(np.arange(256), list(b"0123456789")),
    "upper": np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "marks": np.isin(np.arange(256), list(b"!\"'()+,-./:;=?@[\\]^_`{}~")),
    "high": np.arange(256) >= 0x80,
}
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Field:
    """Weights of a two-label chain: of the features for content, of each label after each, and of the first label."""

    weights: np.ndarray
    follows: np.ndarray
    first: np.ndarray


@dataclass
class Text:
    """A text's words, and the words and features of each of its lines."""

    words: list[bytes]
    data: np.ndarray
    line_words: np.ndarray
    repeated: np.ndarray
    features: np.ndarray


def read_text(text: str | None) -> Text:
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    data = np.frombuffer(raw + b"\n", dtype=np.uint8)
    starts = np.r_[0, np.cumsum([len(x) + 1 for x in lines])[:-1]]
    inside = ~_SPACE[data]
    begins = inside & ~np.r_[False, inside[:-1]]
    total = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    line_words, chars = total(begins), total(inside)
    seen: set[bytes] = set()
    repeated = np.zeros(len(lines), dtype=bool)
    for i, line in enumerate(lines):
        if line_words[i]:
            repeated[i] = line in seen
            seen.add(line)
    share = {name: total(table[data]) / np.maximum(chars, 1) for name, table in _CLASSES.items()}
    stripped = [x.strip() for x in lines]
    columns = {
        "bias": np.ones(len(lines)),
        "words": np.log1p(line_words) / 3,
        "chars_a_word": np.minimum(chars / np.maximum(line_words, 1), 20) / 10,
        **share,
        "symbols_a_word": np.minimum(total(_CLASSES["symbols"][data]) / np.maximum(line_words, 1), 1),
        "ends_sentence": np.array([x.endswith((b".", b"?")) for x in stripped]),
        "starts_upper": np.array([x[:1].isupper() for x in stripped]),
        "address": np.array([b"://" in x or b"www." in x for x in stripped]),
        "repeated": repeated,
        "empty": line_words == 0,
    }
    features = np.stack([np.asarray(columns[name], dtype=np.float64) for name in FEATURES], axis=1)
    return Text(raw.split(), data, line_words, repeated, features)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([numbers[w] for w in words], dtype=np.int64)
    runs, size = ids[:n], len(numbers)
    for i in range(1, window):
        runs = np.unique(runs * size + ids[i : n + i], return_inverse=True)[1]
    twice = np.bincount(runs)[runs] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(window):
        covered[i : n + i] |= twice
    return int(covered.sum())


def viterbi(field: Field, features: np.ndarray) -> np.ndarray:
    """Most probable labels of a sequence of lines; content where two paths are equal."""
    gain = (features @ field.weights).tolist()
    (bb, bc), (cb, cc) = field.follows.tolist()
    boiler, content = field.first[BOILERPLATE], field.first[CONTENT] + gain[0]
    back = []
    for g in gain[1:]:
        from_content = (content + cb >= boiler + bb, content + cc >= boiler + bc)
        back.append(from_content)
        boiler, content = (
            content + cb if from_content[0] else boiler + bb,
            (content + cc if from_content[1] else boiler + bc) + g,
        )
    label = int(content >= boiler)
    labels = [label]
    for step in reversed(back):
        label = int(step[label])
        labels.append(label)
    return np.array(labels[::-1])


def likelihood(field: Field, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, Field]:
    """Mean log-likelihood a line of labelled sequences, and its gradient.

    ``features`` is sequences x lines x features, ``labels`` sequences x
    lines, both filled up behind each sequence's length. Forward and backward
    sums run over all sequences at the same time.
    """
    count, longest, _ = features.shape
    real = np.arange(longest) < lengths[:, None]
    gain = np.zeros((count, longest, 2))
    gain[..., CONTENT] = features @ field.weights
    ahead, behind = np.zeros_like(gain), np.zeros_like(gain)
    ahead[:, 0] = field.first + gain[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.follows, axis=1) + gain[:, t]
        ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(field.follows + (gain[:, t + 1] + behind[:, t + 1])[:, None], axis=2)
        behind[:, t] = np.where(real[:, t + 1, None], step, 0)
    norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
    at = np.exp(ahead + behind - norm[:, None, None]) * real[..., None]
    pairs = np.exp(
        ahead[:, :-1, :, None] + field.follows + (gain + behind)[:, 1:, None] - norm[:, None, None, None]
    ) * real[:, 1:, None, None]
    given = np.eye(2)[labels] * real[..., None]
    given_pairs = given[:, :-1, :, None] * given[:, 1:, None]
    score = (given * gain).sum() + (given_pairs * field.follows).sum() + (given[:, 0] * field.first).sum() - norm.sum()
    lines = lengths.sum()
    gradient = Field(
        np.einsum("sl,slf->f", (given - at)[..., CONTENT], features) / lines,
        (given_pairs - pairs).sum(axis=(0, 1)) / lines,
        (given - at)[:, 0].sum(axis=0) / lines,
    )
    return score / lines, gradient


def fit(sequences: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Field of the sampled ``(features, labels)`` by gradient ascent with moments; all zeros without any."""
    parts = [np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2)]
    if not sequences:
        return Field(*parts)
    lengths = np.array([len(y) for _, y in sequences])
    features = np.zeros((len(sequences), lengths.max(), len(FEATURES)))
    labels = np.zeros(features.shape[:2], dtype=np.int64)
    for i, (x, y) in enumerate(sequences):
        features[i, : len(y)], labels[i, : len(y)] = x, y
    mean, square = [0 * p for p in parts], [0 * p for p in parts]
    for step in range(1, STEPS + 1):
        _, gradient = likelihood(Field(*parts), features, labels, lengths)
        for i, slope in enumerate((gradient.weights, gradient.follows, gradient.first)):
            slope = slope - PENALTY * parts[i]
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
            parts[i] = parts[i] + RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*parts)


def learn_lines(docs: DataFrame, labels: DataFrame) -> Field:
    """Field learnt from a bounded sample of ``docs(doc_id, text)`` with ``labels(doc_id, quality)``.

    ``quality`` 0 makes all lines of a document boilerplate, 1 all content but
    those that repeat an earlier line of it. The sample is the first
    ``SAMPLE_LABELS`` labelled ids by hash, and of their documents the first
    ``SAMPLE_DOCS`` that have at most ``SAMPLE_CHARS`` characters and
    ``SAMPLE_LINES`` lines. Only its features reach the driver.
    """
    of_id = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = of_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_LABELS)
    short = f"length(text) <= {SAMPLE_CHARS} and length(text) - length(replace(text, '\n', '')) < {SAMPLE_LINES}"
    texts = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id")
    sample = texts.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(SAMPLE_DOCS).select("text", "quality")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, marked = [], []
            for text, quality in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist()):
                found = read_text(text)
                features.append(found.features.ravel().tolist())
                marked.append(np.where(found.repeated, BOILERPLATE, quality).tolist())
            columns = [pa.array(features, pa.list_(pa.float64())), pa.array(marked, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["features", "labels"])

    rows = sample.mapInArrow(returning_memory(read), "features array<double>, labels array<int>").collect()
    return fit([(np.reshape(r.features, (-1, len(FEATURES))), np.array(r.labels)) for r in rows])


def judge_lines(docs: DataFrame, field: Field, content_percent: int = CONTENT_PERCENT) -> DataFrame:
    """Statistics and verdict for every row of ``docs(doc_id, text)``.

    Gives ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_content_words, kept``. Words are split at
    ASCII white space. A text fails with fewer than 50 words or with over
    half of them in repeated windows of three. Otherwise it is kept if at
    least ``content_percent`` of its words lie in lines that Viterbi decoding
    labels content. Null and empty texts have no words and fail; repeated
    rows are judged one by one; other columns are ignored; no rows give none.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge_text(t, field, content_percent) for t in batch.column("text").to_pylist()]
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            flags = [pa.array([r[i] for r in rows], pa.bool_()) for i in (6, 7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *flags], ["doc_id", *COLUMNS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COLUMNS)
    return docs.select("doc_id", "text").mapInArrow(returning_memory(judge), schema)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words", "base_failed", "kept")


def judge_text(text: str | None, field: Field, content_percent: int) -> tuple:
    found = read_text(text)
    n_words, n_repeat = len(found.words), repeated_words(found.words)
    chars = int((~_SPACE[found.data] & _STARTS_CHARACTER[found.data]).sum())
    symbols = int(_CLASSES["symbols"][found.data].sum())
    failed = n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words
    content = int(found.line_words[viterbi(field, found.features) == CONTENT].sum())
    kept = not failed and 100 * content >= content_percent * n_words
    return n_words, chars, symbols, int(found.repeated.sum()), n_repeat, content, failed, kept
