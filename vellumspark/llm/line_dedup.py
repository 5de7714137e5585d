"""Removal of repeated passages by winnowing over hashes of word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import wordspans
from vellumspark.llm.common import bloom_blocks, bloom_filter, bloom_may_contain, count_of, cut, fresh, ship
from vellumspark.llm.shingles import mix

#: Runs of so many words are passages.
MIN_WORDS = 50
#: Documents that meet one earlier document in one unit of work.
BLOCK = 128
#: Position of the fingerprint of all words of a document.
WHOLE = -1

_P = np.uint64(0x9E3779B97F4A7C15)


def gram(min_words: int) -> int:
    """Words of a fingerprint: a passage of min_words words holds min_words - gram + 1 of them, one of which is kept."""
    return min_words // 2 + 1


def least_grams(w: np.ndarray, min_words: int) -> np.ndarray:
    """For each run of min_words neighbours among the words' hashes, where its least fingerprint begins (ties: the first).

    Which fingerprint of a passage that is depends on the passage's own words only.
    """
    h = wordspans.grams(w, gram(min_words))
    at, span, width = np.arange(len(h)), min_words - gram(min_words) + 1, 1
    while width < span:
        step = min(width, span - width)
        later = h[step:] < h[:-step]
        at, h = np.where(later, at[step:], at[:-step]), np.minimum(h[step:], h[:-step])
        width += step
    return at


def fingerprints(raw: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, word position) of the winnowed fingerprints of the texts that bounds cuts raw into.

    A fingerprint is the hash of gram(min_words) words. Of those in each passage of min_words words the least is kept, so
    that equal passages, wherever they stand, always share one. Besides, each text has one of all its words, at position
    WHOLE. Texts under min_words words have none.
    """
    _, _, w, first = wordspans.scan(raw, bounds)
    counts = np.diff(first)
    long = counts >= min_words
    none = np.zeros(0, np.int64)
    if not long.any():
        return none, none, none
    w = w[np.repeat(long, counts)]
    number, counts = np.flatnonzero(long), counts[long]
    of = np.cumsum(counts) - counts  # first word of each text
    inside = np.arange(len(w)) - np.repeat(of, counts)
    whole = mix(np.add.reduceat(mix(w + inside.astype(np.uint64) * _P), of) ^ _P)

    least = least_grams(w, min_words)
    fits = inside + min_words <= np.repeat(counts, counts)  # passages that end in their text
    picked = least[fits[: len(least)]]
    picked = picked[np.r_[True, picked[1:] != picked[:-1]]]
    text = np.searchsorted(of, picked, "right") - 1
    h = wordspans.grams(w, gram(min_words))[picked]
    return np.r_[number[text], number], np.r_[h, whole].view(np.int64), np.r_[picked - of[text], np.full(len(number), WHOLE)]


def held(mine: np.ndarray, first: np.ndarray, p: np.ndarray, q: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of min_words words of `mine`: does it repeat `first`, and if not, is its fingerprint among p?

    Equality is extended both ways from the fingerprints at p, which stand in `first` at q, as far as a passage reaches.
    """
    n = len(mine) - min_words + 1
    edges = np.zeros(n + 1, np.int64)
    back = min_words - gram(min_words)
    ahead, behind = np.arange(min_words), -1 - np.arange(back)

    def reach(p: np.ndarray, q: np.ndarray, steps: np.ndarray) -> np.ndarray:
        a, b = p[:, None] + steps, q[:, None] + steps
        there = (a >= 0) & (a < len(mine)) & (b >= 0) & (b < len(first))
        same = there & (mine[np.clip(a, 0, len(mine) - 1)] == first[np.clip(b, 0, len(first) - 1)])
        return np.logical_and.accumulate(same, axis=1).sum(axis=1)

    for i in range(0, len(p), 4096):
        x, y = p[i : i + 4096], q[i : i + 4096]
        lo, hi = x - reach(x, y, behind), x + reach(x, y, ahead) - min_words
        some = hi >= lo
        np.add.at(edges, lo[some], 1)
        np.add.at(edges, hi[some] + 1, -1)
    settled = np.cumsum(edges[:n]) > 0
    asked = np.zeros(len(mine), bool)
    asked[p] = True
    return settled, asked[least_grams(mine, min_words)] & ~settled


def without(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words (at begin to end of raw) of the ranges and the white space behind them; how many went."""
    n = len(begin)
    drop = np.zeros(n, bool)
    for a, b in ranges:
        drop[max(0, a) : b] = True
    if drop.all():
        return "", n
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(raw[at : begin[a]].tobytes())
        at = begin[b] if b < n else len(raw)
    out.append(raw[at:].tobytes())
    return b"".join(out).decode("utf-8", "surrogatepass"), int(drop.sum())


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text that is left, and n_words and removed_words (before, and of them removed).

    Documents are in order of key, then of a checksum of the text. Of each run of at least `min_words` words that stands
    in an earlier document, or earlier in the same one, only the first stays. Each fingerprint's first position is held
    against its later ones, equality is extended word by word both ways, and runs that are long enough go. Pairs are as
    many as later fingerprints; a passage that very many documents share is one leader with blocks of followers. A
    document with just the words of an earlier one goes as a whole, by its fingerprint of all words.

    A passage of `min_words` words that does not go so, though its least fingerprint stands earlier, may still stand in
    another of that fingerprint's positions: all such passages meet by the hash of all their words, and all but the first
    go. No passage is missed: its first place has the same least fingerprint, and either is that fingerprint's first
    position or repeats nothing and so is among those that meet.

    Null text stays null and counts no words; empty text, and texts under `min_words` words, stay as they are. Null keys
    come first. Rows of equal key and text are one document: they are treated alike. A text that goes as a whole becomes
    empty. Columns of docs called n_words or removed_words go, others stay. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != text and c.lower() not in ("n_words", "removed_words")]
    k0, th, body, spans = fresh(docs, "k0_", "th_", "body_", "spans_")
    least = F.lit(-(2**63))
    base = docs.select(*kept, F.coalesce(F.col(key).cast("long"), least).alias(k0), F.xxhash64(F.col(text)).alias(th), F.col(text).alias(body))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = (batch.column(c).to_numpy() for c in (0, 1))
            for i, raw, bounds in wordspans.pieces(batch.column(2)):
                at, h, pos = fingerprints(raw, bounds, min_words)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h, keys[i + at], hashes[i + at], pos))], names=["h", "k", "t", "pos"])

    prints = base.select(k0, th, body).mapInArrow(mark, "h long, k long, t long, pos long").persist()
    firsts = prints.groupBy("h").agg(F.min(F.struct("k", "t", "pos")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "f.*").toDF("h", "fk", "ft", "fpos")
    firsts = cut(firsts)  # apart from the sums, the join's partitions can be split where a fingerprint is very frequent
    later = prints.join(firsts, "h").where("not (k = fk and t = ft and pos = fpos)")
    anchor = F.when(F.col("pos") != WHOLE, F.struct("fk", "ft", "pos", "fpos"))
    repeats = cut(later.groupBy("k", "t").agg(F.max(F.col("pos") == WHOLE).alias("copy"), F.collect_set(anchor).alias("anchors")))
    prints.unpersist()
    copies = repeats.where("copy").select("k", "t", F.lit(0).cast("long").alias("a"), F.lit(2**62).alias("b"))
    pairs = repeats.where("not copy").select("k", "t", F.explode("anchors").alias("x")).groupBy("k", "t", "x.fk", "x.ft").agg(F.collect_list(F.struct("x.pos", "x.fpos")).alias("anchors"))
    pairs = cut(pairs)

    sizes = pairs.groupBy("fk", "ft").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("units"))
    members = pairs.join(sizes, ["fk", "ft"]).withColumn("unit", F.pmod(F.xxhash64("k", "t"), F.col("units")).cast("int"))
    leaders = sizes.select(F.col("fk").alias("k"), F.col("ft").alias("t"), "fk", "ft", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"))
    leaders = leaders.withColumn("anchors", F.lit(None).cast("array<struct<pos:bigint,fpos:bigint>>"))
    needs = members.select(*leaders.columns).unionByName(leaders)

    ids = needs.select("k", "t").distinct()
    n = count_of(ids)
    blocks = bloom_blocks(n)
    near = bloom_filter(ids.select(F.xxhash64("k", "t").alias("x")), "x", blocks) if n else None
    asked = base.where(bloom_may_contain(near, F.xxhash64(k0, th), blocks)) if n else base.limit(0)
    texts = asked.select(F.col(k0).alias("k1"), F.col(th).alias("t1"), F.col(body).alias("body")).dropDuplicates(["k1", "t1"])
    rows = needs.join(texts, (F.col("k") == F.col("k1")) & (F.col("t") == F.col("t1"))).select("fk", "ft", "unit", F.col("anchors").isNotNull().alias("follows"), "k", "t", "anchors", "body")
    rows = rows.repartition("fk", "ft", "unit").sortWithinPartitions("fk", "ft", "unit", "follows")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for batch in batches:
            follows, ks, ts, anchors = (batch.column(c) for c in ("follows", "k", "t", "anchors"))
            for i, raw, bounds in wordspans.pieces(batch.column("body")):
                _, _, hashes, at = wordspans.scan(raw, bounds)
                out: list = [[np.zeros(0, np.int64)] for _ in range(6)]
                for n in range(len(at) - 1):
                    own = hashes[at[n] : at[n + 1]]
                    if not follows[i + n].as_py():
                        first = own.copy()
                        continue
                    p, q = (x.to_numpy() for x in anchors[i + n].values.flatten())
                    settled, open_ = held(own, first, p, q, min_words)
                    edges = np.flatnonzero(np.diff(np.r_[False, settled, False].astype(np.int8)))
                    left = np.flatnonzero(open_)
                    a, b = np.r_[edges[::2], left], np.r_[edges[1::2] - 1, left] + min_words
                    h = np.r_[np.zeros(len(edges) // 2, np.int64), wordspans.grams(own, min_words)[left].view(np.int64)]
                    asks = np.arange(len(a)) >= len(edges) // 2
                    for c, v in zip(out, (np.full(len(a), ks[i + n].as_py()), np.full(len(a), ts[i + n].as_py()), a, b, h, asks), strict=True):
                        c.append(v)
                k, t, a, b, h, asks = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (k, t, a, b)), pa.array(h, mask=asks == 0)], names=["k", "t", "a", "b", "h"])

    judged = cut(rows.mapInArrow(match, "k long, t long, a long, b long, h long"))
    again = judged.where("h is not null")
    firsts = again.groupBy("h").agg(F.min(F.struct("k", "t", "a")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "f.*").toDF("h", "fk", "ft", "fa")
    again = again.join(firsts, "h").where("not (k = fk and t = ft and a = fa)").select("k", "t", "a", "b")
    found = judged.where("h is null").select("k", "t", "a", "b").unionByName(again).unionByName(copies)
    found = found.groupBy("k", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    found = cut(found)
    n = count_of(found)
    blocks = bloom_blocks(n)
    none = F.lit(None).cast("array<struct<a:bigint,b:bigint>>")
    if n:
        near = bloom_may_contain(bloom_filter(found.select(F.xxhash64("k", "t").alias("x")), "x", blocks), F.xxhash64(k0, th), blocks)
        hit = base.where(near).join(found.select(F.col("k").alias("k1"), F.col("t").alias("t1"), F.col("spans").alias(spans)), (F.col(k0) == F.col("k1")) & (F.col(th) == F.col("t1")), "left").select(*kept, body, spans)
        both = hit.unionByName(base.where(~near).select(*kept, body, none.alias(spans)))
    else:
        both = base.select(*kept, body, none.alias(spans))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, bounds in wordspans.pieces(batch.column(body)):
                part = batch.slice(i, len(bounds) - 1)
                begin, end, _, at = wordspans.scan(raw, bounds, hashed=False)
                texts, ranges = part.column(body), part.column(spans)
                gone = np.zeros(len(texts), np.int64)
                if hits := np.flatnonzero(ranges.is_valid()).tolist():
                    left = texts.to_pylist()
                    for n in hits:
                        of, to = bounds[n], slice(at[n], at[n + 1])
                        left[n], gone[n] = without(raw[of : bounds[n + 1]], begin[to] - of, end[to] - of, [(x["a"], x["b"]) for x in ranges[n].as_py()])
                    texts = pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), texts, pa.array(np.diff(at)), pa.array(gone)], names=[*kept, text, "n_words", "removed_words"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), f"`{text}` string", "n_words long", "removed_words long"])
    return both.mapInArrow(remove, fields)
