"""Token counts of whole texts, with overlap resynchronisation for huge ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import fresh, ship

_models: dict = {}
MARK = "▁"


def load(path: str):
    """The tokenizer, once in each worker, and whether its boundaries before spaces are proven.

    They are where no piece of the vocabulary has the space mark behind another character: then no merge crosses the
    place between a character that is no space and a space, and what stands on its two sides is encoded apart.
    """
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proven = not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size()))
        _models[path] = sp, proven
    return _models[path]


def _pieces(sp, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
    got = sp.encode(text, return_type="offset_mapping")
    return np.fromiter((o[0] for o in got["offsets"]), np.int64, len(got["ids"])) + at, np.array(got["ids"], dtype=np.int64)


def _splice(text: str, left: tuple, right: tuple, lo: int, hi: int) -> int | None:
    """A boundary in text[lo:hi] from which both encodings have the same pieces up to the last boundary there."""
    is_cut = lambda c: text[c] == " " and text[c - 1] not in (" ", MARK)
    cuts = [c for c in range(lo + 1, hi) if is_cut(c)]
    if len(cuts) < 4:
        return None
    end = cuts[-1]
    for c in (cuts[len(cuts) // 2], cuts[1]):
        (a, x), (b, y) = left, right
        i, j = (a >= c) & (a < end), (b >= c) & (b < end)
        if np.array_equal(a[i], b[j]) and np.array_equal(x[i], y[j]):
            return c
    return None


def count_tokens(sp, proven: bool, text: str, chunk: int, overlap: int) -> int:
    """The number of tokens of the whole text, as the library gives it for the text in one call.

    Texts of up to two chunks are encoded at once. Longer ones are encoded in chunks that overlap; neighbours are
    spliced at a proven boundary where they agree. If there is none, the overlap is doubled, and where it has reached
    the last splice, the chunk itself grows, up to the whole text.
    """
    if len(text) <= 2 * chunk or not proven:
        return len(sp.encode(text))
    total, done, lo, hi = 0, 0, 0, chunk
    left = _pieces(sp, text[:hi], 0)
    while hi < len(text):
        wide, at = overlap, None
        while hi - wide > done:
            start = hi - wide
            right = _pieces(sp, text[start : start + chunk + wide], start)
            at = _splice(text, left, right, start, hi)
            if at is not None:
                break
            wide *= 2
        if at is None:
            hi = min(len(text), hi + max(chunk, hi - lo))
            left = _pieces(sp, text[lo:hi], lo)
            continue
        total += int(((left[0] >= done) & (left[0] < at)).sum())
        done, lo, left = at, hi - wide, right
        hi = min(len(text), lo + chunk + wide)
    return total + int((left[0] >= done).sum())


def with_token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); the text column goes.

    Null text counts as empty: no bytes and no tokens. Other columns stay as they are; columns of docs that have one
    of the three names go. Rows are neither moved nor merged; equal texts of a batch are encoded once.
    """
    ship(docs.sparkSession)
    names = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c.lower() not in names]
    (own,) = fresh(docs.select(*kept), "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, proven = load(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(own).to_pylist()]
            distinct = dict.fromkeys(texts)
            short = [t for t in distinct if len(t) <= 2 * chunk]
            for i in range(0, len(short), 64):
                part = short[i : i + 64]
                distinct.update(zip(part, map(len, sp.encode(part, num_threads=1)), strict=True))
            for t, n in distinct.items():
                if n is None:
                    distinct[t] = count_tokens(sp, proven, t, chunk, overlap)
            n = np.array([distinct[t] for t in texts], dtype=np.int64)
            size = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size), pa.array(n), pa.array(n > limit)], names=[*kept, *names])

    source = docs.select(*kept, F.col(text).alias(own))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "n_bytes long", "n_tokens long", "over_limit boolean"])
    return source.mapInArrow(run, fields)
