"""Words of many texts at once against bytes.split()."""

import numpy as np
import pyarrow as pa
import pytest

from vellumspark.llm import wordspans


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("piece", [1, 40, 1 << 16])
def test_words_of_pieces(kind, piece, monkeypatch):
    monkeypatch.setattr(wordspans, "PIECE", piece)
    texts = ["a b  c\nd", "", None, "  x y ", "é ü a b c", "\t\r\n", "w" * 300 + " end", "last", None]
    seen: dict = {}
    for column, want in ((pa.array(texts, kind), texts), (pa.array(texts, kind).slice(3, 4), texts[3:7]), (pa.array([], kind), [])):
        got = []
        for i, raw, bounds in wordspans.pieces(column):
            begin, end, hashes, first = wordspans.scan(raw, bounds)
            assert i == len(got)
            for a, b in zip(first[:-1], first[1:]):
                got.append([raw[x:y].tobytes() for x, y in zip(begin[a:b], end[a:b])])
            for x, y, h in zip(begin, end, hashes.tolist()):
                assert seen.setdefault(raw[x:y].tobytes(), h) == h
            assert np.array_equal(wordspans.scan(raw, bounds, hashed=False)[3], first)
        assert got == [(t or "").encode().split() for t in want]
    assert len(set(seen.values())) == len(seen)
