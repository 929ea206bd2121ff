"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker keeps; the cache is emptied when it is full.
CACHE_WORDS = 1_000_000


class WordHashes(dict):
    """xxh3 of words, computed once per worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """ASCII letters in lower case, split at ASCII white space (which is what ``bytes`` methods do)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(words: int) -> np.ndarray:
    """One odd factor for each place in a shingle."""
    return mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of ``words`` words, sorted; a shorter text is one shingle, no word is none."""
    own = words_of(text)
    if not own:
        return np.empty(0, dtype=np.uint64)
    hashed = np.array(list(map(HASHES.__getitem__, own)), dtype=np.uint64)
    size = min(words, len(hashed))
    count = len(hashed) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(count, size, dtype=np.uint64)
        for place, weight in enumerate(_weights(size)):
            total += hashed[place : place + count] * weight
        return np.unique(mixed(total))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
