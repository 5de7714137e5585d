"""Toxicity scores: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import cut, fresh, release, ship

#: Labelled rows that the model is fitted on at most (those of least hash), and entries of the learnt lexicon at most.
SAMPLE, LEXICON = 20_000, 2_000
#: First letters of a word that count as an entry beside whole words.
STEMS = (4, 5, 6)
#: A lexicon entry stands in so many toxic texts at least, and is so many times as frequent there as elsewhere.
LEAST_TEXTS, LEAST_RATIO = 5, 8.0

# Second-person words of the four languages of the texts.
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "u", "ur", "du", "dein", "deine", "dich", "dir", "euch", "ihr", "sie",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros",
}
# Characters that stand for letters in obfuscated words.
OBFUSCATION = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

WORD, STEM, PERSON, CAPS, TITLE, MIXED, LONG_RUN, HIDDEN = (1 << i for i in range(8))
FEATURES = (
    "lexicon_density", "lexicon_count", "stem_density", "stem_count", "hidden_density", "person_density", "near_person", "near_share",
    "caps_share", "caps_words", "title_words", "exclaim", "question", "other_marks", "mixed_words", "stretched_words", "mean_word", "log_words",
)
_MEMO = 1 << 18


def entries(word: str) -> list[str]:
    """What a word is looked up as: itself, and its first letters as stems."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class Features:
    """Dense features of texts for a lexicon; words are judged once and remembered, the last _MEMO to 2 x _MEMO of them."""

    def __init__(self, lexicon: set[str]) -> None:
        self.lexicon = lexicon
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def judge(self, raw: str) -> int:
        if raw in self.older:
            self.memo[raw] = flags = self.older[raw]
            return flags
        word = raw.strip(".,;:!?\"'()[]{}…«»“”-#%&*$")
        low = word.lower()
        flags = 0
        if low in self.lexicon:
            flags |= WORD
        if any(f"{low[:n]}*" in self.lexicon for n in STEMS if len(low) > n):
            flags |= STEM
        if low in SECOND_PERSON:
            flags |= PERSON
        if len(word) > 1 and word.isupper():
            flags |= CAPS
        elif word[:1].isupper():
            flags |= TITLE
        if any(c.isalpha() for c in word) and not word.isalpha():
            flags |= MIXED
            plain = "".join(c for c in low.translate(OBFUSCATION) if c.isalpha())
            if plain != low and plain in self.lexicon:
                flags |= HIDDEN
        if any(a == b == c for a, b, c in zip(low, low[1:], low[2:], strict=False)):
            flags |= LONG_RUN
        self.memo[raw] = flags
        return flags

    def of(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        memo, judge = self.memo, self.judge
        for row, text in enumerate(texts):
            words = text.split()
            n = len(words)
            if not n:
                continue
            codes = np.fromiter((memo[w] if w in memo else judge(w) for w in words), np.uint8, n)
            if len(memo) > _MEMO:
                self.older = memo
                memo = self.memo = {}
            by = np.bincount(codes, minlength=256)
            count = lambda bit: int(by[_HAS[bit]].sum())  # noqa: B023, E731
            hits, stems, hidden = count(WORD), count(STEM), count(HIDDEN)
            near = 0
            if count(PERSON) and hits + stems + hidden:
                person = np.flatnonzero(codes & PERSON)
                bad = np.flatnonzero(codes & (WORD | STEM | HIDDEN))
                at = np.searchsorted(person, bad)
                left, right = np.abs(bad - person[np.maximum(at - 1, 0)]), np.abs(person[np.minimum(at, len(person) - 1)] - bad)
                near = int((np.minimum(left, right) <= 5).sum())
            size = len(text)
            marks = sum(map(text.count, "#%&*$@"))
            out[row] = (
                hits / n, hits, stems / n, stems, hidden / n, count(PERSON) / n, near, near / n, count(CAPS) / n, count(CAPS), count(TITLE) / n,
                text.count("!") / size, text.count("?") / size, marks / size, count(MIXED) / n, count(LONG_RUN) / n, size / n, np.log1p(n),
            )
        return out


_HAS = {1 << i: np.flatnonzero(np.arange(256) & (1 << i)) for i in range(8)}


class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss, over histograms of at most 64 bins a feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0) -> None:
        self.depth, self.rate = depth, rate
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1])) for c in x.T]
        binned = self.bin(x)
        width = max(len(e) for e in self.edges) + 1
        base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(base / (1 - base)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(depth):
                nodes = 1 << level
                best = np.full(nodes, -np.inf)
                feature, at = np.zeros(nodes, np.int64), np.full(nodes, width, np.int64)
                for j in range(x.shape[1]):
                    cell = node * width + binned[:, j]
                    hist = lambda v: np.bincount(cell, v, nodes * width).reshape(nodes, width).cumsum(1)  # noqa: B023, E731
                    gl, hl = hist(g), hist(h)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = -np.inf
                    k = gain.argmax(1)
                    value = gain[np.arange(nodes), k]
                    better = value > np.maximum(best, 1e-9)
                    best[better], feature[better], at[better] = value[better], j, k[better]
                splits.append((feature, at))
                node = node * 2 + (binned[np.arange(len(y)), feature[node]] > at[node])
            leaf = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            self.trees.append((splits, leaf))
            f += rate * leaf[node]

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bin(x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, at in splits:
                node = node * 2 + (binned[rows, feature[node]] > at[node])
            f += self.rate * leaf[node]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising margins with their calibrated values, for linear interpolation."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1][0] += a
            blocks[-1][1] += b
            blocks[-1][2] += c
    s, n, m = np.array(blocks).T
    return m / n, s / n


@dataclass
class Model:
    lexicon: set[str]
    trees: Trees | None
    curve: tuple[np.ndarray, np.ndarray] | None
    base: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.base)
        return np.clip(np.interp(self.trees.margin(features), *self.curve), 0, 1)


def _lexicon(sample: DataFrame) -> set[str]:
    """Words and stems far more frequent in toxic texts than in others, by texts that hold them, over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                found, marks = [], []
                for text, y in zip(batch.column(0).slice(i, 100).to_pylist(), batch.column(1).slice(i, 100).to_pylist(), strict=True):
                    own = {e for w in {w.strip(".,;:!?\"'()[]{}…«»“”-#%&*$") for w in text.lower().split()} if w for e in entries(w)}
                    found += own
                    marks += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["entry", "y"])

    counts = sample.select("text", "y").mapInArrow(run, "entry string, y int").groupBy("entry").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    bad, n = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    ratio = (F.col("bad") / bad) / ((F.col("n") - F.col("bad") + 1) / F.lit(n - bad))
    top = counts.where((F.col("bad") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).orderBy(F.desc("bad"), "entry").limit(LEXICON)
    return {r.entry for r in top.select("entry").collect()}


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    """Fits lexicon, trees and calibration on labelled rows whose crc32(doc_id as text) mod `folds` is not `held_out`.

    At most SAMPLE labelled ids, those of least hash, are used, so the fit's cost has a bound. Another of the remaining
    folds calibrates the trees that the rest has grown. Without labels of both kinds the score is the mean label, or 0.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    ids = ids.where(fold != held_out).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE)
    ids = F.broadcast(ids.select(F.col("doc_id").alias("of"), "y"))  # SAMPLE rows of two numbers
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("of"))
    sample = cut(sample.select("text", "y", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(4)).cast("int").alias("part")))
    bad, n = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    if not bad or bad == n:
        return Model(set(), None, None, float(bad or 0) / max(n, 1))
    lexicon = _lexicon(sample.where("part > 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            x = features.of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1), batch.column(2)], names=[*FEATURES, "y", "part"])

    got = sample.mapInArrow(run, ", ".join(f"{c} double" for c in FEATURES) + ", y int, part int").toPandas()
    got = got.sort_values(list(got.columns))
    x, y, calibrate = got[list(FEATURES)].to_numpy(), got["y"].to_numpy(float), got["part"].to_numpy() == 0
    if len(set(y[~calibrate])) < 2 or len(set(y[calibrate])) < 2:
        calibrate = np.zeros(len(y), bool)
    trees = Trees(x[~calibrate], y[~calibrate])
    use = calibrate if calibrate.any() else ~calibrate
    return Model(lexicon, trees, isotonic(trees.margin(x[use]), y[use]), float(bad) / n)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where score >= 0.5); whole texts, all rows.

    Only the text is an input of a score; labels, ids, language and source are not. Null text counts as empty and gets
    the score of no features. Columns of docs with one of the two names go, others stay.
    """
    ship(docs.sparkSession)
    model = train(docs, labels)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    (own,) = fresh(docs.select(*kept), "text_")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(held.value.lexicon)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                score = held.value.score(features.of([t or "" for t in part.column(own).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])
        features = None
        release()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), "score double", "predicted int"])
    return docs.select(*kept, F.col(text).alias(own)).mapInArrow(run, fields)
