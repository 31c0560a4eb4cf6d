"""Word shingles as 64-bit hashes.

Words are maximal runs of letters and digits of the lower-cased text; a shingle is `SIZE` words in
a row. A text of fewer words has one shingle, of all its words; a text without words has none.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

SIZE = 5
CACHE = 150_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
find_words = re.compile(r"[^\W_]+").findall


class WordHashes(dict):
    """A word's hash; when full, it begins anew."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = h
        return h


hashes = WordHashes()


def words_of(text: str | None) -> list[str]:
    return find_words((text or "").lower())


def shingle_hashes(words: list[str], size: int = SIZE) -> np.ndarray:
    """A hash for each place where a shingle (of `size` words) begins, in order; repeated shingles stay."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(size, n)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = h * FACTOR + w[i : n - size + 1 + i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs (odd factor, offset) that reorder the 64-bit numbers."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def shingles_sql(table: str, key: str) -> str:
    """SQL for the distinct (key, s) of a table with a column text; s is the shingle as text."""
    words = f"(SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})"
    return (
        f"SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM {words} WHERE len(w) >= 5"
        f" UNION ALL SELECT {key}, array_to_string(w, ' ') AS s FROM {words} WHERE len(w) BETWEEN 1 AND 4"
    )
