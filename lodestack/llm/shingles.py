"""Word shingles as 64-bit hashes, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Words whose hashes a worker remembers, and the bytes of the longest of them: some 60 MB together at most.
_WORD_CACHE, _LONGEST = 300_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingle hashes of texts; remembers the hashes of words, up to a bound."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            self.powers = _BASE ** np.arange(1, words + 1, dtype=np.uint64)

    def word_hashes(self, raw: bytes) -> np.ndarray:
        """Of the words of the whole text; A-Z as a-z."""
        parts, known = raw.lower().split(), self.known
        try:
            return np.array([known[w] for w in parts], np.uint64)
        except KeyError:
            if len(known) > _WORD_CACHE:
                known.clear()
            found = {w: known[w] if w in known else xxhash.xxh3_64_intdigest(w) for w in set(parts)}
            known.update((w, h) for w, h in found.items() if len(w) <= _LONGEST)
            return np.array([found[w] for w in parts], np.uint64)

    def __call__(self, raw: bytes) -> np.ndarray:
        """Sorted distinct hashes; of fewer words than a shingle has, one for the whole sequence; of no words, none."""
        h = self.word_hashes(raw)
        n, k = len(h), self.words
        if not n:
            return h
        with np.errstate(over="ignore"):
            if n < k:
                return mix((h * self.powers[:n]).sum(keepdims=True) + np.uint64(n))
            s = h[: n - k + 1] * self.powers[0]
            for j in range(1, k):
                s += h[j : n - k + 1 + j] * self.powers[j]
        return np.unique(mix(s + np.uint64(k)))
