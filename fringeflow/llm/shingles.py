"""Hashed word shingles of texts, worked out over whole byte arrays."""

from __future__ import annotations

import numpy as np

# Bytes whose running sums are held at once, unless one word is longer.
SEGMENT = 1 << 20
# Words are counted in so many buckets, by their hash.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the words of a text: A-Z lower-cased, split at ASCII white space."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _extend(self, size: int) -> None:
        if len(self.powers) < size:
            size = 1 << int(size - 1).bit_length()
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each of the successive stretches ``starts`` to ``ends`` of some bytes."""
        out = np.zeros(len(starts), dtype=np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + SEGMENT, SEGMENT))
        for first, last in zip(cuts[:-1], cuts[1:]):
            if first == last:
                continue
            low, high = starts[first], ends[last - 1]
            self._extend(high - low + 1)
            part = _BYTES[data[low:high]] * self.powers[: high - low]
            sums = np.r_[np.uint64(0), np.cumsum(part, dtype=np.uint64)]
            start = starts[first:last] - low
            out[first:last] = (sums[ends[first:last] - low] - sums[start]) * self.inverses[start]
        return mixed(out)

    def words(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        inside = np.r_[False, ~_SPACES[data], False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return self.spans(data, edges[::2], edges[1::2])

    def runs(self, words: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words; fewer words count as one run, none as no run."""
        if not len(words):
            return words
        size = min(width, len(words))
        runs = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            runs = mixed(runs * np.uint64(_BASE) + words[i : len(words) - size + 1 + i])
        return runs

    def shingles(self, text: str, width: int) -> np.ndarray:
        """Sorted distinct hashes of runs of ``width`` words."""
        return np.unique(self.runs(self.words(text), width))


def word_buckets(words: np.ndarray) -> np.ndarray:
    """Bucket of each word's hash, of ``BUCKETS``."""
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def run_levels(words: np.ndarray, n_runs: int, levels: np.ndarray) -> np.ndarray:
    """For each run of words the sum of its words' levels, which ``levels`` holds by bucket."""
    sums = np.r_[0, np.cumsum(levels[word_buckets(words)], dtype=np.int64)]
    size = len(words) - n_runs + 1
    return sums[size:] - sums[:n_runs]
