"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
#: Words kept in a worker's table of word hashes.
WORDS = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles of a text's words (A-Z lower-cased), sorted; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SIZE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - SIZE + 1
    runs = hashes[:n]
    for k in range(1, SIZE):
        runs = mixed(runs + np.uint64(0x9E3779B97F4A7C15)) ^ hashes[k:n + k]
    return np.unique(mixed(runs))
