"""Words, shingles and signatures of texts, in Python workers."""

from __future__ import annotations

import numpy as np

WORDS = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_MEMO = 1 << 18


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


hashes = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """Of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.split() and bytes.lower() know just these."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: their whole sequence as one; none: empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    m = min(k, len(w))
    n = len(w) - m + 1
    h = np.full(n, m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(m):
            h = mix(h * _P + w[i : i + n])
    return np.unique(h)


_rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """`size` minima of the set under different hash functions, 16 bits kept of each."""
    if size not in _rows:
        rng = np.random.default_rng(20_240_607)
        _rows[size] = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size, dtype=np.uint64)
    a, b = _rows[size]
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        x = shingles[i : i + 256, None] * a + b
        low = np.minimum(low, x.min(axis=0))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a ∩ b| >= percent * |a ∪ b|, for sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
