"""Words of many texts at once, as arrays over their bytes, in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vellumspark.llm.shingles import mix

#: Bytes of texts that are worked on together; one longer text goes by itself.
PIECE = 1 << 16


def among(values: bytes) -> np.ndarray:
    """For each byte, whether it is one of the values."""
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


SPACE = among(b" \t\n\x0b\x0c\r")
_VALUES = np.random.default_rng(20_250_301).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """At least n powers of the odd number _BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, PIECE), base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def scan(raw: np.ndarray, bounds: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begin and end of all words [^\\x20\\x09-\\x0D]+ in raw, their 64-bit hashes, and the first word of each text.

    Text n is raw[bounds[n]:bounds[n + 1]], bounds start at 0; the last of the first words is the number of words.
    A word's hash is a polynomial of its bytes' values, had from sums over all bytes before.
    """
    n = len(raw)
    solid = ~SPACE[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    opens[cuts] |= solid[cuts]
    closes[cuts - 1] |= solid[cuts - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(begin, bounds)
    if not hashed:
        return begin, end, np.zeros(0, np.uint64), first
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * power[:n], out=sums[1:])
    return begin, end, (sums[end] - sums[begin]) * inverse[begin], first


def grams(w: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of each run of so many neighbours among the words' hashes."""
    n = len(w)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(w) * power[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows of a string column, of about PIECE bytes; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
