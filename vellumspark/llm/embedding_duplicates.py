"""Embedding near-duplicates by product quantisation over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import cut, ship
from vellumspark.llm.components import components

#: The index is fitted on so many vectors at most (those of least hash); every vector is indexed.
SAMPLE = 65_536
#: Subspaces of a residual, codes for each subspace. Inverted lists are as many as the square root of the vectors, and
#: LISTS at most (16.8 million vectors): beyond that they grow longer and are searched in blocks all the same.
SUBSPACES, CODES, LISTS = 8, 256, 4096
#: Vectors of the sample for each list.
PER_LIST = 64
#: Members, or queries, that meet in one unit of work.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096))])


class Index:
    """Coarse centroids, and codebooks of their residuals for each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, reach: float) -> None:
        self.reach = reach
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [kmeans(residual[:, p], CODES, 5, 7 + i) for i, p in enumerate(self.parts)]

    def probed(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Row by row: does a vector of the list `own` lie within half the reach of the plane between the two lists?

        A vector and a link of it in another list are at most reach apart, on the two sides of that plane, so one of them
        lies within half the reach of it: probes by these vectors alone are sufficient for all links.
        """
        w = self.coarse[other] - self.coarse[own]
        before = np.einsum("ij,ij->i", (self.coarse[other] + self.coarse[own]) / 2 - x, w)
        return before <= (self.reach / 2 + 1e-9) * np.sqrt(np.einsum("ij,ij->i", w, w))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each vector's list, codes and quantisation error, and the lists that it probes (its own is one of them)."""
        d = squares(x, self.coarse)
        own = d.argmin(1)
        residual = x - self.coarse[own]
        codes = np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            residual[:, p] -= b[codes[:, i]]
        error = np.sqrt((residual**2).sum(1))
        slack = d - d[np.arange(len(x)), own][:, None] - (self.reach + 2e-9) * np.sqrt(squares(self.coarse[own], self.coarse))
        beyond = slack <= 0
        # where rounding could decide, the row by row form does: the search asks it again
        row, at = np.nonzero(np.abs(slack) < 1e-6)
        beyond[row, at] = self.probed(x[row], own[row], at)
        beyond[np.arange(len(x)), own] = True
        return own, codes, error, [np.flatnonzero(b) for b in beyond]

    def distances(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries to coded members of the list `at`, by table look-up."""
        rest = query - self.coarse[at]
        out = np.zeros((len(query), len(codes)), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out += np.take(squares(rest[:, p], b).astype(np.float32), codes[:, i], axis=1)
        return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index for each of n vertices over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (least key reachable), kept; a row for each row.

    Links: cosine >= `cosine` in double precision. Equal vectors are one representative with a count, so copies cost no
    pairs. Every representative is coded into one inverted list and probes the lists whose plane is within half the reach
    of it; of two linked vectors one probes the other's list at least (see Index.probed), and where both do, the pair
    counts in the list of the smaller number. Table look-ups leave members whose distance to the code, less the code's
    error, is within reach, so none is lost; the rest is confirmed by the exact cosine. Lists are cut into blocks, and
    each unit of work (a block of members, a block of queries) reports counts and a spanning forest of its links, not the
    links. A unit holds 2 x BLOCK vectors; a list of very many unequal vectors costs the square of them in comparisons.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of unequal
    length count as padded with zeros. Null key: component null, kept; its vector still counts in others' n_links.
    Rows with an equal key are one vertex of the components. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = np.dtype("<f4" if element == "float" else "<f8")  # shipped as they came; all arithmetic is in double precision
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{'float' if element == 'float' else 'double'}>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vec", lambda x: x != 0)
    rows = cut(rows.withColumn("vec", F.when(~F.coalesce(bad, F.lit(True)), F.col("vec"))))
    groups = rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("mult"), F.min("key").alias("vertex"))
    reps = cut(groups.select(F.monotonically_increasing_id().alias("rep"), "vec", "mult", "vertex"))
    count, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not count:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))

    def padded(column: pa.Array) -> np.ndarray:
        """The vectors of a list column as rows of `width` components."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(column.offsets.to_numpy())
        x = np.zeros((len(column), width), kind)
        x[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return x

    def unit_rows(raw: np.ndarray) -> np.ndarray:
        x = raw.astype(np.float64)
        x /= np.abs(x).max(1)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]

    lists = min(LISTS, int(np.ceil(np.sqrt(count))))
    sample = reps.orderBy(F.xxhash64("vec"), "rep").limit(min(SAMPLE, PER_LIST * lists)).select("vec").toArrow().column(0)
    index = Index(unit_rows(padded(sample)), lists, float(np.sqrt(2 - 2 * cosine)))
    held = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = padded(batch.column(1))
            own, codes, error, probes = held.value.assign(unit_rows(raw))
            bytes_ = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            names = ["rep", "mult", "own", "error", "code", "vec", "probes"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own.astype(np.int32)), pa.array(error), bytes_(codes), bytes_(raw), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))], names=names)

    placed = reps.select("rep", "vec", "mult").mapInArrow(place, "rep long, mult long, own int, error double, code binary, vec binary, probes array<int>")
    placed = cut(placed)
    members = placed.select(F.col("own").alias("list"), F.lit(True).alias("member"), "rep", "mult", "own", "error", "code", "vec")
    queries = placed.select(F.explode("probes").alias("list"), F.lit(False).alias("member"), "rep", "mult", "own", F.lit(0.0).alias("error"), F.lit(b"").alias("code"), "vec")
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = blocks(members, "mb").join(blocks(queries, "qb"), "list")
    sizes = F.broadcast(cut(sizes))  # LISTS rows of three numbers at most
    dealt = members.unionByName(queries).join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("member"), F.col("mb")).otherwise(F.col("qb"))).cast("int"))
    other = F.sequence(F.lit(0), F.when(F.col("member"), F.col("qb")).otherwise(F.col("mb")) - 1)
    dealt = dealt.withColumn("o", F.explode(other)).select(
        "list", F.when(F.col("member"), F.col("part")).otherwise(F.col("o")).alias("i"), F.when(F.col("member"), F.col("o")).otherwise(F.col("part")).alias("j"), "member", "rep", "mult", "own", "error", "code", "vec"
    )
    dealt = dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", F.desc("member"))

    def links_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        """Counts and forest of one unit: its members come first, then its queries."""
        ix = held.value
        t = pa.Table.from_batches(parts).combine_chunks()
        at = t.column("list")[0].as_py()
        rep, mult, own, error = (t.column(c).to_numpy() for c in ("rep", "mult", "own", "error"))
        vec = unit_rows(np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(len(rep), width))
        k = int(np.count_nonzero(t.column("member").to_numpy(zero_copy_only=False)))
        if not 0 < k < len(rep):
            return None
        codes = np.frombuffer(b"".join(t.column("code").slice(0, k).to_pylist()), np.uint8).reshape(k, -1)
        within = ((ix.reach + error[:k] + 1e-5) ** 2).astype(np.float32)
        n = np.zeros(len(rep), np.int64)
        found_q, found_m = [], []
        for i in range(k, len(rep), 256):
            near = ix.distances(vec[i : i + 256], at, codes) <= within
            a, b = np.nonzero(near)
            a += i
            differ = rep[a] != rep[b]
            a, b = a[differ], b[differ]
            for c in range(0, len(a), 65_536):
                x, y = a[c : c + 65_536], b[c : c + 65_536]
                ok = np.einsum("ij,ij->i", vec[x], vec[y]) >= cosine
                x, y = x[ok], y[ok]
                apart = own[x] != at  # else both are queries and members here, and each counts for itself
                both = np.flatnonzero(apart)
                if len(both):  # where the member probes the query's list as well, the smaller list counts
                    also = ix.probed(vec[y[both]], np.full(len(both), at), own[x[both]])
                    drop = both[also & (own[x[both]] < at)]
                    use = np.ones(len(x), bool)
                    use[drop] = False
                    x, y, apart = x[use], y[use], apart[use]
                np.add.at(n, x, mult[y])
                np.add.at(n, y[apart], mult[x[apart]])
                found_q.append(x)
                found_m.append(y)
        some = np.flatnonzero(n)
        if not len(some):
            return None
        ids, back = np.unique(rep, return_inverse=True)
        root = roots(len(ids), back[np.concatenate(found_q)], back[np.concatenate(found_m)])
        tied = np.flatnonzero(root != np.arange(len(ids)))
        u, v = np.r_[rep[some], ids[tied]], np.r_[rep[some], ids[root[tied]]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.r_[n[some], np.zeros(len(tied), np.int64)])], names=["u", "v", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.stack([batch.column(c).to_numpy() for c in ("list", "i", "j")], axis=1)
            edges = np.r_[0, np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, len(unit)]
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if tuple(unit[begin]) != at:
                    if parts and (out := links_of(parts)):
                        yield out
                    at, parts = tuple(unit[begin]), []
                parts.append(batch.slice(begin, end - begin))
        if parts and (out := links_of(parts)):
            yield out

    found = cut(dealt.mapInArrow(search, "u long, v long, n long"))
    linked = found.groupBy(F.col("u").alias("of")).agg(F.sum("n").alias("n"))
    vertex = reps.select(F.col("rep").alias("r"), "vertex")
    ties = found.where("u <> v").select("u", "v").distinct()
    ties = ties.join(vertex, F.col("u") == F.col("r")).select(F.col("vertex").alias("a"), "v").join(vertex, F.col("v") == F.col("r")).select("a", F.col("vertex").alias("b"))
    counts = reps.join(linked, F.col("rep") == F.col("of"), "left").select(F.col("vec").alias("of_vec"), "vertex", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = rows.join(counts, F.col("vec") == F.col("of_vec"), "left").select("key", "vertex", "n_links")
    named = cut(named)
    edges = ties.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(named.where("vertex is not null").select(F.col("key").alias("u"), F.col("vertex").alias("v")))
    comp = components(edges)
    out = named.select("key", "n_links").join(comp, F.col("key") == F.col("vertex"), "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
