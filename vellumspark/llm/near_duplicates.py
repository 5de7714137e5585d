"""MinHash near-duplicates by a multi-index Hamming join over signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import shingles
from vellumspark.llm.common import bloom_blocks, bloom_filter, bloom_may_contain, count_of, cut, release, ship
from vellumspark.llm.components import components

#: A signature has CHUNKS chunks of ROWS minima. A pair is a candidate if some chunk has one differing place at most;
#: leaving out each place of each chunk in turn enumerates all such chunks. A pair that differs in RADIUS places at most
#: always has one (pigeonhole: RADIUS < 2 * CHUNKS).
CHUNKS, ROWS = 12, 4
SIZE, RADIUS = CHUNKS * ROWS, 2 * CHUNKS - 1
#: Bins of the sketch that goes with a signature: in each, one byte of the set's least hash there (0: none).
BINS = 512
#: 16-bit places of a signature with its set's size and its sketch.
WIDE = SIZE + 2 + BINS // 2
#: Standard deviations that a sketch may fall short of a link's similarity (chance of about 3 in 100,000).
SPREAD = 4.0
#: Members of a leader, and rows of a bucket, that meet in one unit of work.
BLOCK, ROWS_BLOCK = 512, 2048


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For signatures (n, SIZE): (n, SIZE) 64-bit keys, one for each place left out of its chunk."""
    n = len(sig)
    s = sig.reshape(n, CHUNKS, ROWS).astype(np.uint64)
    out = np.empty((n, CHUNKS, ROWS), np.uint64)
    with np.errstate(over="ignore"):
        for skip in range(ROWS):
            h = np.full((n, CHUNKS), skip + 1, np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(16)
            for r in range(ROWS):
                if r != skip:
                    h = shingles.mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
            out[:, :, skip] = h
    return out.reshape(n, SIZE).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """BINS bytes of a set's sorted hashes."""
    at = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.zeros(BINS, np.uint8)
    out[at[first]] = hashes[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def wide(hashes: np.ndarray) -> bytes:
    return shingles.signature(hashes, SIZE).tobytes() + np.uint32(len(hashes)).tobytes() + sketch(hashes)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For rows (n, WIDE) or one row against them: may they link?

    Sets of too unequal sizes can't link. Each bin that is not empty in both is a draw, without replacement, from the
    union of the two sets, and both bytes are equal if it is from the intersection; so the share of equal bins is that of
    a hypergeometric sample, nearly exact for short texts.
    """
    a, b = (np.ascontiguousarray(np.atleast_2d(x)[:, SIZE:]).view(np.uint8) for x in (a, b))
    n, m = (x[:, :4].copy().view(np.uint32).ravel().astype(np.float64) for x in (a, b))
    a, b = a[:, 4:], b[:, 4:]
    used = ((a | b) != 0).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    p = percent / 100
    sd = np.sqrt(p * (1 - p) / used * np.maximum(0, 1 - used * (1 + p) / (n + m)))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (same + 1 >= (p - SPREAD * sd) * used)


def sign(docs: DataFrame) -> DataFrame:
    """key, n (shingles), set_id (16 bytes that equal sets share), sig (WIDE x 16 bits; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, ids, sigs = [], [], []
            memo: dict = {}
            for text in batch.column(1).to_pylist():
                if text not in memo:
                    s = shingles.shingle_set(text)
                    memo[text] = (len(s), xxhash.xxh128_digest(s.tobytes()), wide(s)) if len(s) else (0, None, None)
                a, b, c = memo[text]
                n.append(a)
                ids.append(b)
                sigs.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["key", "th", "n", "set_id", "sig"])
        memo = {}
        release()

    return docs.select("key", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "key long, th long, n long, set_id binary, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(k, rep): the chunk keys of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, WIDE)
                keys = chunk_keys(sig[:, :SIZE])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), SIZE))], names=["k", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "k long, rep long")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Pairs are grouped by a; an a with many partners is dealt out in units of BLOCK, to each of which its text goes
    once. A task reads its rows in order and holds one set of an a at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("units"))
    members = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("units")).cast("int").alias("unit"))
    of = texts.select(F.col("rep").alias("of"), "text")
    right = members.join(of, F.col("b") == F.col("of")).select("a", "unit", "b", "text")
    left = members.select("a", "unit").distinct().join(of, F.col("a") == F.col("of")).select("a", "unit", F.lit(None).cast("long").alias("b"), "text")
    rows = left.unionByName(right).repartition("a", "unit").sortWithinPartitions("a", "unit", F.col("b").asc_nulls_first()).select("a", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            found_a, found_b = [], []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    mine = shingles.shingle_set(text)
                elif shingles.enough(mine, shingles.shingle_set(text), percent):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _rest(keys: DataFrame, reps: DataFrame, comp: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Candidate pairs (a < b) of the same bucket in different components, as far as known, however far their signatures.

    With `nearest`, not all of them: for each row, the one that differs in the fewest places, by signatures alone, and in
    RADIUS at most.

    Only buckets that hold two components are looked into. A large bucket is cut into blocks and each pair of blocks is
    a unit of work. Rows of the component that is most frequent in a unit are not held against each other, and a pair
    counts only in the first of its buckets.
    """
    named = keys.join(comp, F.col("rep") == F.col("vertex"), "left").select("k", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = named.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k", F.ceil(F.col("size") / ROWS_BLOCK).cast("int").alias("blocks"))
    rows = named.join(mixed, "k").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("other", F.explode(others)).select(
        "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("first"), (F.col("block") == F.col("other")).alias("own"), "rep", "comp"
    )
    sigs = reps.select(F.col("rep").alias("of"), F.substring("sig", 1, 2 * SIZE + 4).alias("sig") if nearest else F.col("sig"))
    rows = rows.join(sigs, F.col("rep") == F.col("of")).select("k", "i", "j", "first", "own", "rep", "comp", "sig").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def pairs_of(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, comp = np.array(part["rep"]), np.array(part["comp"])
        both = np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(-1, SIZE + 2 if nearest else WIDE)
        sig = np.ascontiguousarray(both[:, :SIZE])
        n = both[:, SIZE : SIZE + 2].copy().view(np.uint32).ravel().astype(np.int64)
        keys = chunk_keys(sig)
        place = int(np.flatnonzero(keys[0] == part["k"][0])[0])
        own, first = part["own"][0], np.array(part["first"])
        values, counts = np.unique(comp, return_counts=True)
        common = values[counts.argmax()]
        found: list = [[np.zeros(0, np.int64)] for _ in range(3)]
        for i in np.flatnonzero(comp != common):
            far = (sig != sig[i]).sum(axis=1)
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if not own:
                ok &= first != first[i]
            j = np.flatnonzero(ok)
            if nearest:
                j = j[far[j] <= RADIUS]
                j = j[[far[j].argmin()]] if len(j) else j
            elif len(j):
                j = j[~(keys[j, :place] == keys[i, :place]).any(axis=1)]
                if len(j):
                    j = j[alike(both[j], both[i], percent)]
            for c, values in zip(found, (np.full(len(j), rep[i]), rep[j], far[j]), strict=True):
                c.append(values)
        a, b, far = map(np.concatenate, found)
        if nearest:
            return a, b, far
        return (*np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        out: list = []

        def flush() -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            a, b, far = (np.concatenate([none, *(x[c] for x in out)]) for c in range(3))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far if nearest else np.zeros(len(a), np.int64))], names=["a", "b", "far"])

        for batch in batches:
            for row in batch.to_pylist():
                unit = row["k"], row["i"], row["j"]
                if unit != at:
                    if part and len(part["rep"]) > 1:
                        out.append(pairs_of(part))
                        if sum(len(x[0]) for x in out[-100:]) > 100_000 or len(out) > 1000:
                            yield flush()
                    at, part = unit, {c: [] for c in ("k", "first", "own", "rep", "comp", "sig")}
                for c, values in part.items():
                    values.append(row[c])
        if part and len(part["rep"]) > 1:
            out.append(pairs_of(part))
        yield flush()

    found = rows.mapInArrow(run, "a long, b long, far long")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
    return found.select("a", "b")


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, n_shingles, component (least key reachable over links), kept (key is its component); a row for each row.

    Links: 100 * |A ∩ B| >= percent * |A ∪ B| over the sets of five-word shingles. Candidates are all pairs that share a
    chunk key, among them all whose signatures differ in RADIUS places at most (a pair of similarity 0.75 shares none with
    a chance of about 1 in 10,000,000); each link is confirmed on the full sets. The first two rounds of comparisons
    keep to the radius; what they leave out is left to the last one.

    1. Equal sets are one representative. 2. In each bucket of a chunk key, the least representative is held against
    the others: as many pairs as rows, and a group of copies, however large, is joined by them. 3. Each row of a bucket of
    several components is held against its nearest one of another component, which joins most of what is left, again
    with as many pairs as rows at most. 4. All pairs of a bucket that are still in different components are searched in
    blocks and confirmed as well; pairs already in one component need no check, as a link could add nothing. So no link between different components is lost and no group is expanded into
    all its pairs. Set sizes and sketches (see alike) spare most of the full comparisons.

    Null or empty text, or one without words: an empty set, linked with nothing. Null key: component null, kept, linked
    with nothing. Rows with an equal key are one vertex. An empty table gives no rows. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = cut(sign(source))
    full = signed.where("key is not null and n > 0")
    by_set = full.groupBy("set_id").agg(F.min("key").alias("rep"))
    same = full.join(by_set, "set_id").select("key", "th", "rep", "sig", "set_id")
    # a key may stand in several rows of different texts: a representative is a set, named by a number of its own
    first = same.where("key = rep").groupBy("set_id").agg(F.min(F.struct("th", "sig")).alias("x"), F.min("rep").alias("vertex"))
    reps = cut(first.select(F.monotonically_increasing_id().alias("rep"), "x.sig", "x.th", "vertex"))
    keys = _keys(reps)
    firsts = keys.groupBy("k").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("k", "a")
    keys = cut(keys.join(firsts, "k").select("k", "rep", "a"))
    stars = keys.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sigs = reps.select(F.col("rep").alias("of"), F.substring("sig", 1, 2 * SIZE + 4).alias("sig"))  # without the sketch
    stars = stars.join(sigs.withColumnRenamed("sig", "sig_a"), F.col("a") == F.col("of")).drop("of").join(sigs.withColumnRenamed("sig", "sig_b"), F.col("b") == F.col("of")).drop("of")
    stars = cut(_within(stars, percent))
    wanted = stars.select(F.col("a").alias("r")).unionByName(stars.select(F.col("b").alias("r"))).distinct()
    links = cut(_verify(stars, _texts(source, reps, wanted), percent))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    keys = keys.select("k", "rep")
    for nearest in (True, False):
        comp = cut(components(links))
        rest = _rest(keys, reps, comp, percent, nearest)
        rest = cut(rest.join(tried, ["a", "b"], "left_anti"))
        wanted = rest.select(F.col("a").alias("r")).unionByName(rest.select(F.col("b").alias("r"))).distinct()
        # what is tied so far goes on as stars
        tied = comp.where("vertex <> component").select(F.col("vertex").alias("u"), F.col("component").alias("v"))
        links = cut(tied.unionByName(_verify(rest, _texts(source, reps, wanted), percent)))
        tried = tried.unionByName(rest)

    vertex = reps.select(F.col("rep").alias("of"), "vertex")
    named = links.join(vertex.withColumnsRenamed({"of": "of_u", "vertex": "vu"}), F.col("u") == F.col("of_u")).join(vertex.withColumnsRenamed({"of": "of_v", "vertex": "vv"}), F.col("v") == F.col("of_v"))
    edges = named.select(F.col("vu").alias("u"), F.col("vv").alias("v")).unionByName(same.select(F.col("key").alias("u"), F.col("rep").alias("v")))
    comp = components(edges)
    out = signed.join(comp, F.col("key") == F.col("vertex"), "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def _within(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) within the radius whose sets are not too unequal in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SIZE + 2) for i in (2, 3))
                n, m = (x[:, SIZE:].copy().view(np.uint32).ravel().astype(np.int64) for x in (a, b))
                ok = pa.array(((a[:, :SIZE] != b[:, :SIZE]).sum(axis=1) <= RADIUS) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
                yield batch.select(["a", "b"]).filter(ok)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _texts(source: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the wanted representatives, found by key and checksum."""
    need = cut(reps.join(wanted, F.col("rep") == F.col("r"), "left_semi").select("rep", "vertex", F.col("th").alias("of_th")))
    blocks = bloom_blocks(count_of(need))
    near = bloom_filter(need, "of_th", blocks)  # texts that nobody asks for are not shuffled
    rows = source.withColumn("th", F.xxhash64("text"))
    return rows.where(bloom_may_contain(near, F.col("th"), blocks)).join(need, (F.col("key") == F.col("vertex")) & (F.col("th") == F.col("of_th"))).select("rep", "text")
