"""Word and shingle hashes, a document at a time without a Python step per shingle."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import worker_state
from .near import finish

_K = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """A bounded cache from a word's bytes to its 64-bit hash."""

    LIMIT = 250_000

    @staticmethod
    def shared() -> WordHashes:
        return worker_state("word-hashes", WordHashes)

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of_text(self, text: str | None) -> np.ndarray:
        """Words lower-cased in A-Z, split at ASCII white space (bytes.lower and bytes.split do just that)."""
        return self.of_words(text.encode().lower().split()) if text else np.empty(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; their number of words is part of the hash."""
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = finish(total * _K + words[k : k + n])
    return total
