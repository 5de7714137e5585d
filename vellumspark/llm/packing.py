"""Order-preserving packing of token streams by dynamic programming."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import fresh, release, ship

#: What a cut inside a document costs, in tokens of padding: at a sentence's end, and anywhere else.
SENTENCE_PENALTY, HARD_PENALTY = 16, 256
#: Tokens that one run of the dynamic program looks at, and words that a worker remembers.
BUFFER, MEMO = 1 << 20, 1 << 20
#: Marks that a word may end in; none of them is part of a special token or a contraction.
MARKS = ".,;:!?#%&*$-()"

_encoders: dict = {}


class Words(dict):
    """Numbers of words in the order in which they are asked for; 0 is the empty word."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


class WordEncoder:
    """Ids of whole texts for a tokenizer whose pre-tokens never reach over a space or line feed.

    This tokenizer folds runs of white space to one space, splits by a pattern that matches no white space, and
    merges inside those parts only; so a text's ids are those of its space-separated words in a row, and each word is
    encoded once by the library and remembered. `load` holds that property against the tokenizer's own description.
    Beyond `memo` words, only those that came again since the last time stay remembered, the half that came most at most.
    """

    def __init__(self, tokenizer, memo: int | None = None) -> None:
        self.tokenizer, self.memo = tokenizer, MEMO if memo is None else memo
        self.clear()

    def clear(self) -> None:
        self.index = Words()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        # of each word: where its ids begin in flat, how many they are, how often it was asked for
        self.off, self.size, self.seen = (np.zeros(1, np.int64) for _ in range(3))

    def _forget(self) -> None:
        stay = np.flatnonzero(self.seen > 1)
        if len(stay) > self.memo // 2:
            stay = np.sort(stay[np.argpartition(-self.seen[stay], self.memo // 2)[: self.memo // 2]])
        stay = stay[stay > 0]
        flags = np.zeros(len(self.seen), bool)
        flags[stay] = True
        words = [w for w, keep in zip(self.index, flags.tolist(), strict=True) if keep]  # a word's index is its place
        flat, size = self._ids(stay), self.size[stay]
        self.clear()
        self.index.update(zip(words, range(1, len(words) + 1), strict=True))
        self.flat, self.used = np.r_[flat, np.zeros(1 << 16, np.int32)].astype(np.int32), len(flat)
        self.off, self.size, self.seen = np.r_[0, np.cumsum(size) - size], np.r_[0, size], np.zeros(len(words) + 1, np.int64)

    def _ids(self, idx: np.ndarray) -> np.ndarray:
        """The ids of the words idx in a row."""
        size = self.size[idx]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.off[idx] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _store(self, ids: np.ndarray, number: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[number], self.size[number] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def _learn(self) -> None:
        """Encodes the words that are new. One that ends in marks is put together from the word before them and the marks.

        A letter and such a mark are never in the same part, and parts are merged by themselves; ASCII letters are
        lower-cased by the tokenizer anyway.
        """
        index, old = self.index, len(self.seen)
        numbers, plain, whole, head, tail = [], [], [], [], []
        for n, word in enumerate(index.take_new(), old):
            core = word.rstrip(MARKS)
            low = core.lower() if core.isascii() else core
            if low != word and core[-1:].lower().isalpha():  # no letter whose small form ends in a combining mark
                whole.append(n)
                head.append(index[low])
                tail.append(index[word[len(core) :]])
            else:
                numbers.append(n)
                plain.append(word)
        parts = index.take_new()
        numbers += range(len(index) - len(parts), len(index))
        plain += parts
        grown = np.zeros(len(index) - old, np.int64)
        self.off, self.size, self.seen = (np.r_[x, grown] for x in (self.off, self.size, self.seen))
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            enc = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            at = np.fromiter((o[0] for o in enc.offsets), np.int64, len(enc))
            self._store(np.array(enc.ids, dtype=np.int32), np.array(numbers[i : i + 512]), np.diff(np.searchsorted(at, ends, side="left"), prepend=0))
        if whole:
            both = np.stack([head, tail], axis=1)
            self._store(self._ids(both.ravel()), np.array(whole), self.size[both].sum(axis=1))
            np.add.at(self.seen, both.ravel(), 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.seen) > self.memo:
            self._forget()
        words = " ".join(texts).replace("\n", " ").split(" ")
        idx = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._learn()
        self.seen += np.bincount(idx, minlength=len(self.seen))
        last = np.cumsum([t.count(" ") + t.count("\n") + 1 for t in texts], dtype=np.int64)
        ends = np.cumsum(self.size[idx])
        return self._ids(idx), np.diff(ends[last - 1], prepend=0) if len(last) else np.zeros(0, np.int64)


class PlainEncoder:
    """Ids from the library, text by text, for any other tokenizer."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], dtype=np.int32), np.array([len(ids) for ids in got], dtype=np.int64)


def load(path: str, memo: int | None = None):
    """(encoder, ids that end a sentence), once in each worker."""
    if (path, memo) not in _encoders:
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        about = json.loads(tokenizer.to_str())
        steps = [s["type"] for s in (about["normalizer"] or {}).get("normalizers", [])]
        parts = (about["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        apart = (
            steps == ["NFC", "Replace", "Lowercase"]
            and about["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and parts[0].get("type") == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and pattern.split("|")[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] and " " not in pattern
            and not parts[1].get("add_prefix_space")
            and not any(" " in a["content"] or a["lstrip"] or a["rstrip"] for a in about["added_tokens"])
        )
        ends = [i for t, i in tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+(</w>)?", t)]
        _encoders[path, memo] = WordEncoder(tokenizer, memo) if apart else PlainEncoder(tokenizer), np.array(sorted(ends), dtype=np.int32)
    return _encoders[path, memo]


def choose_cuts(places: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Indices into places (ascending, from 0 to the end) at which windows of at most `length` tokens end.

    The sum of padding and penalties is least; best_cuts finds the same sum where any token may end a window. The best way to a place is over the place before it, within reach, for
    which cost so far plus position is least; a queue kept in rising order of that value gives it in constant time.
    """
    p, pen = places.tolist(), penalty.tolist()
    n = len(p)
    value, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    value[0] = 0  # cost so far plus position
    for j in range(1, n):
        at = p[j]
        while at - p[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        v = value[i] + length + pen[j]  # value[i] + length - at + pen[j], plus at
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def best_cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> list[int]:
    """Positions, the last of them n, at which windows of at most `length` of n tokens end.

    The sum of padding and penalties is least, and any token may end a window. Padding is windows times length less n, so
    moving a cut on to a later place of the same kind within reach never costs more: from a cut, the next one is at the
    last document end in reach, at the last sentence end, or where the window is full. Of two ways, the one that costs no
    more and is as far on is as good for all that follows; so ways are taken up by rising cost, and only those that are
    farther on than all before. The first that is at n is the best.
    """
    docs, sentences = doc_ends.tolist(), sentence_ends.tolist()
    ways = [(0, 0, -1)]  # cost, how far on (negative), number of the way before
    taken: list[tuple[int, int]] = []
    far = -1
    while True:
        cost, at, before = heapq.heappop(ways)
        at = -at
        if at <= far:
            continue
        far = at
        taken.append((at, before))
        if at == n:
            break
        me, cost, end = len(taken) - 1, cost + length, min(at + length, n)
        i = bisect_right(docs, end)
        last = end if end == n else docs[i - 1] if i else 0
        if last > far:
            heapq.heappush(ways, (cost, -last, me))
        if last < end:
            i = bisect_right(sentences, end)
            if i and sentences[i - 1] > max(last, far):
                last = sentences[i - 1]
                heapq.heappush(ways, (cost + SENTENCE_PENALTY, -last, me))
            if last < end:
                heapq.heappush(ways, (cost + HARD_PENALTY, -end, me))
    out = []
    at, before = taken[-1]
    while before >= 0:
        out.append(at)
        at, before = taken[before]
    return out[::-1]


def pack_stream(batches: Iterator[tuple[list, list[str]]], encoder, sentence_ids: np.ndarray, length: int, end_id: int, first: int, buffer: int = BUFFER) -> Iterator[dict]:
    """Pieces of one ordered stream of (keys, texts); sequence numbers count from `first`."""
    sequence = first
    keys: list = []
    ids = np.zeros(0, np.int32)
    # documents that the buffer touches: ids that came before the buffer, ids in the buffer, ids in all
    before, inside, total = (np.zeros(0, np.int64) for _ in range(3))

    def emit(last: bool) -> dict | None:
        nonlocal sequence, keys, ids, before, inside, total
        if not len(ids):
            return None
        ends = np.cumsum(inside)
        cuts = np.array(best_cuts(len(ids), ends, np.flatnonzero(np.isin(ids, sentence_ids)) + 1, length))
        if not last:
            if len(cuts) < 2:
                return None
            cuts = cuts[:-1]  # what follows the last full window waits for more
        edge = int(cuts[-1])
        starts = ends - inside
        points = np.unique(np.concatenate([[0], cuts, starts[starts < edge]]))
        a, b = points[:-1], points[1:]
        doc = np.searchsorted(ends, a, side="right")
        window = np.searchsorted(cuts, a, side="right")
        from_ = np.r_[0, cuts][window]
        raw = memoryview(ids.astype("<u4").tobytes())
        out = {
            "key": [keys[d] for d in doc.tolist()],
            "start": a - starts[doc] + before[doc],
            "length": b - a,
            "ids_crc32": np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a)),
            "doc_tokens": total[doc],
            "sequence_id": window + sequence,
            "offset": a - from_,
        }
        sequence += len(cuts)
        used = np.clip(edge - starts, 0, inside)
        stay = np.flatnonzero(used < inside)
        before, inside, total = (before + used)[stay], (inside - used)[stay], total[stay]
        keys = [keys[i] for i in stay.tolist()]
        ids = ids[edge:]
        return out

    for batch_keys, texts in batches:
        if not texts:
            continue
        got, size = encoder.encode(texts)
        ends = np.cumsum(size)
        with_end = np.insert(got, ends, end_id).astype(np.int32)
        keys += batch_keys
        ids = np.concatenate([ids, with_end])
        before = np.concatenate([before, np.zeros(len(size), np.int64)])
        inside, total = np.concatenate([inside, size + 1]), np.concatenate([total, size + 1])
        if len(ids) >= buffer and (out := emit(False)):
            yield out
    if out := emit(True):
        yield out


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text", memo: int | None = None) -> DataFrame:
    """Packs documents, in the order in which the table holds them, into sequences of at most `length` tokens.

    A document is its ids and then end_id. Windows are cut where padding plus penalties is least: documents' ends cost
    nothing, sentence ends little, other places more. Each id
    lies in exactly one piece; pieces of a sequence follow each other without gaps. Each input partition is a stream
    of its own, read once in order with a bounded buffer: no text is moved, and sequence ids hold the partition number
    in their upper bits. A partition's last sequence may be short. A worker remembers about `memo` words (MEMO); fewer take
    less memory and more time, and the result is the same.

    Null text: empty, so one piece with end_id. Equal keys or null keys: each row is a document of its own. An empty
    table gives no rows. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    own_key, own_text = fresh(docs.limit(0), "key_", "text_")
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias(own_key), F.col(text).alias(own_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        encoder, sentence_ids = load(tokenizer_path, memo)
        first = TaskContext.get().partitionId() << 40
        small = ((b.column(0).slice(i, 250), b.column(1).slice(i, 250)) for b in batches for i in range(0, b.num_rows, 250))
        rows = ((k.to_pylist(), [t or "" for t in v.to_pylist()]) for k, v in small)
        for x in pack_stream(rows, encoder, sentence_ids, length, end_id, first):
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x["key"], key_type(kind)), *(pa.array(np.asarray(x[c], dtype=np.int64)) for c in names)], names=[key, *names])
            release()

    return source.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def key_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
