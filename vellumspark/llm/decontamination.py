"""Benchmark decontamination: SimHash windows, a multi-index Hamming join, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import ascii_lower, bloom_blocks, bloom_filter, bloom_may_contain, cut, fresh

WORDS = 5
#: Bits of each block of a fingerprint. Two fingerprints at most RADIUS bits apart differ in at most one bit of some
#: block (pigeonhole: RADIUS < 2 * blocks); an item's blocks are listed with all values one bit away.
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
RADIUS = 2 * len(BLOCKS) - 1


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint> `out`: hashes of the five-word shingles in order; fewer words: their sequence as one; none: empty.

    The words go through a generator of one row, so that no expression behind it splits the text again.
    """
    split = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t-\\r]+"), "")
    (w,) = fresh(df, "words_")
    df = df.select("*", F.explode(F.array(split)).alias(w))
    n = F.size(w)
    places = F.slice(F.sequence(F.lit(0), n), 1, F.greatest(n - WORDS + 1, F.lit(0)))
    whole = F.transform(places, lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WORDS))))
    few = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(n >= WORDS, whole).otherwise(few)).drop(w)


def _joined(votes: DataFrame, of: list[str]) -> DataFrame:
    """of, and the fingerprint `fp` whose bits are set where the columns b0 to b63 are positive."""
    bit = lambda b: F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    print_ = bit(0)
    for b in range(1, 64):
        print_ = print_.bitwiseOR(bit(b))
    return votes.select(*of, print_.alias("fp"))


def _fingerprints(rows: DataFrame, of: list[str]) -> DataFrame:
    """SimHash of the rows' hashes `h` with weights `c`, by `of`: a bit is set where its weighted votes are positive."""
    vote = lambda b: F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("c")).otherwise(-F.col("c"))).alias(f"b{b}")
    return _joined(rows.groupBy(*of).agg(*(vote(b) for b in range(64))), of)


def _blocks(fp: Column, near: bool) -> Column:
    """array<struct<no, value>>: the blocks of a fingerprint, and with `near` all values at most one bit away."""
    out, at = [], 0
    for no, bits in enumerate(BLOCKS):
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        out += [F.struct(F.lit(no).alias("no"), value.bitwiseXOR(F.lit(m)).alias("value")) for m in [0, *(1 << i for i in range(bits) if near)]]
        at += bits
    return F.array(*out)


def _segments(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, a, b): the ranges `lo` to `hi` of each `by`, put together where they overlap or touch."""
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    seen = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = ranges.withColumn("opens", F.when(F.col("lo") <= seen + 1, 0).otherwise(1))
    numbered = opens.withColumn("no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "no").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).drop("no")


def _inside(segments: DataFrame, held: DataFrame) -> DataFrame:
    """segments with a row for each shingle `h`, at `p`, of the windows of m shingles that start at a to b."""
    rows = segments.join(held.select("rid", "sh"), "rid")
    rows = rows.select(*segments.columns, F.posexplode(F.slice("sh", F.col("a") + 1, F.col("b") + F.col("m") - F.col("a"))).alias("i", "h"))
    return rows.withColumn("p", F.col("a") + F.col("i")).drop("i")


def _window_fingerprints(segments: DataFrame, held: DataFrame) -> DataFrame:
    """(rid, m, start, fp): SimHash of each window of m shingles that starts in a segment (rid, m, n, a, b).

    From one start to the next a shingle leaves and one enters; a running sum of their bits gives each window's votes.
    """
    rows = _inside(segments, held)
    enters = F.struct(F.greatest(F.col("a"), F.col("p") - F.col("m") + 1).alias("at"), F.lit(1).alias("sign"))
    leaves = F.struct((F.col("p") + 1).alias("at"), F.lit(-1).alias("sign"))
    rows = rows.select("rid", "m", "n", "a", "b", "h", F.explode(F.array(enters, leaves)).alias("e")).where("e.at <= b")
    by = ["rid", "m", "a"]
    rows = rows.select(*by, "n", "h", "e.at", "e.sign").repartition(*by).sortWithinPartitions(*by, "at")  # bits only behind the sort
    bits = [(F.shiftright("h", b).bitwiseAND(F.lit(1)).cast("int") * F.col("sign")).alias(f"s{b}") for b in range(64)]
    order = Window.partitionBy(*by).orderBy("at")
    last = F.lead("at").over(order).alias("next")
    sums = [F.sum(f"s{b}").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"b{b}") for b in range(64)]
    rows = rows.select(*by, "n", "at", *bits).select(*by, "n", "at", last, *sums).where("next is null or next > at")
    size = F.least(F.col("m"), F.col("n") - F.col("at"))
    votes = rows.select("rid", "m", F.col("at").alias("start"), *((2 * F.col(f"b{b}") - size).alias(f"b{b}") for b in range(64)))
    return _joined(votes, ["rid", "m", "start"])


def _best_windows(segments: DataFrame, held: DataFrame, of_items: DataFrame) -> DataFrame:
    """(rid, iid, m, n, s, start): the most shingles, by multiplicity, that a window in a segment (rid, iid, m, n, a, b) shares with the item.

    An occurrence of a shingle that the item holds c times counts where the window holds it, but not the c-th one before
    it too: for the starts of one interval. Sums over the intervals' ends, in order, give the shared number at each start.
    """
    hits = _inside(segments, held).join(of_items.select("iid", "h", "c"), ["iid", "h"])
    at = hits.groupBy("rid", "iid", "m", "n", "a", "b", "h", "c").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    before = lambda j: F.when(j >= F.col("c"), F.get(F.col("ps"), (j - F.col("c")).cast("int"))).otherwise(F.lit(-1))
    spans = F.transform("ps", lambda p, j: F.struct(F.greatest(F.col("a"), p - F.col("m") + 1, before(j) + 1).alias("lo"), F.least(p, F.col("b")).alias("hi")))
    spans = at.select("rid", "iid", "m", "n", "a", F.explode(spans).alias("x")).where("x.lo <= x.hi")
    ends = F.array(F.struct(F.col("x.lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("x.hi") + 1).alias("at"), F.lit(-1).alias("d")))
    steps = spans.select("rid", "iid", "m", "n", "a", F.explode(ends).alias("e")).groupBy("rid", "iid", "m", "n", "a", "e.at").agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy("rid", "iid", "m", "n", "a").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    shared = steps.withColumn("s", F.sum("d").over(order))
    best = shared.groupBy("rid", "iid", "m", "n").agg(F.max(F.struct("s", (-F.col("at")).alias("y"))).alias("best"))
    return best.select("rid", "iid", "m", "n", "best.s", (-F.col("best.y")).alias("start"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 75) -> DataFrame:
    """(key, text_hash, item, start_word, end_word, similarity): the best window of each document and item that it leaks.

    A window is as long as the item. Its similarity is the weighted Jaccard similarity of the two shingle multisets:
    shared multiplicities over all multiplicities; `percent` or more is a leak.

    1. A window that is similar enough shares one of any so many of the item's shingles that the rest would be too few.
       The rarest such shingles of each item are anchors; a Bloom filter of them passes the documents that may hold one,
       and an exact join gives anchors' places. All windows that hold an anchor are looked at, whatever their start;
       those without one cannot leak. 2. They and the items get SimHash fingerprints; a multi-index join finds the
       pairs of a length that are at most RADIUS bits apart. 3. The exact similarity decides, at each start of the
       windows found and of those that hold an anchor of the item itself, which may be farther apart.

    Of equally similar windows the first is given. Null or empty texts, on either side, leak nothing. An item of fewer
    than five words is leaked only by a document that is that sequence of words. Null keys and repeated rows: each row is
    judged by itself, equal results are given once. Empty tables give no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    items = with_shingles(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("body")), "body", "sh").drop("body")
    items = items.where(F.size("sh") > 0).distinct()
    items = cut(items.select(F.monotonically_increasing_id().alias("iid"), "item", "sh", F.size("sh").alias("m")))
    placed = items.select("iid", "m", F.posexplode("sh").alias("q", "h"))
    common = placed.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("iid").orderBy("df", "h", "q")
    anchors = placed.join(common, "h").withColumn("r", F.row_number().over(rarest))
    anchors = cut(anchors.where(F.col("r") <= F.floor(F.col("m") * (100 - percent) / 100) + 1).select("iid", "m", "h").distinct())
    distinct = anchors.select("h").distinct().count()
    shape = f"`{key}` {docs.schema[key].dataType.simpleString()}, text_hash long, `{item}` {benchmark.schema[item].dataType.simpleString()}, start_word long, end_word long, similarity double"
    if not distinct:
        return spark.createDataFrame([], shape)
    blocks = bloom_blocks(distinct, 1024)  # a document asks with each of its shingles
    filled = bloom_filter(anchors.select("h"), "h", blocks)

    k, t = fresh(docs.limit(0), "key_", "text_")
    source = docs.select(F.col(key).alias(k), F.col(text).alias(t))
    source = source.select(F.col(k).alias("key"), F.xxhash64(t).alias("text_hash"), F.col(t).alias("body"))
    every = with_shingles(source, "body", "sh").select("key", "text_hash", F.posexplode("sh").alias("pos", "h"))
    hits = cut(every.where(bloom_may_contain(filled, F.col("h"), blocks)).join(anchors, "h").select("key", "text_hash", "pos", "m", "iid").distinct())
    ids = cut(hits.select("text_hash").distinct())
    wanted = bloom_blocks(ids.count(), 256)
    near = bloom_may_contain(bloom_filter(ids, "text_hash", wanted), F.col("text_hash"), wanted)
    held = with_shingles(source.where(near).join(ids, "text_hash", "left_semi"), "body", "sh").select("key", "text_hash", "sh").dropDuplicates(["key", "text_hash"])
    held = cut(held.select(F.monotonically_increasing_id().alias("rid"), "key", "text_hash", "sh"))
    named = held.select("rid", F.col("key").alias("k2"), F.col("text_hash").alias("t2"), F.size("sh").alias("n"))
    hits = hits.join(named, F.col("key").eqNullSafe(F.col("k2")) & (F.col("text_hash") == F.col("t2")))
    first, last = F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("m")))
    anchored = cut(hits.select("rid", "iid", "m", "n", first.alias("lo"), last.alias("hi")).where("lo <= hi"))
    of_items = placed.groupBy("iid", "m", "h").agg(F.count(F.lit(1)).alias("c"))

    listed = _fingerprints(of_items, ["iid", "m"]).select("iid", "m", F.col("fp").alias("ifp"), F.explode(_blocks(F.col("fp"), True)).alias("b")).select("iid", "m", "ifp", "b.no", "b.value")
    asked = _window_fingerprints(_segments(anchored.select("rid", "m", "n", "lo", "hi").distinct(), ["rid", "m", "n"]), held)
    asked = asked.select("rid", "start", "m", "fp", F.explode(_blocks(F.col("fp"), False)).alias("b")).select("rid", "start", "m", "fp", "b.no", "b.value")
    near = asked.join(listed, ["m", "no", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("rid", "iid", "m", "start").distinct()
    near = near.join(held.select("rid", F.size("sh").alias("n")), "rid").select("rid", "iid", "m", "n", F.col("start").alias("lo"), F.col("start").alias("hi"))
    found = _best_windows(_segments(anchored.unionByName(near), ["rid", "iid", "m", "n"]), held, of_items)
    judged = found.join(held.select(F.col("rid").alias("r2"), "key", "text_hash"), F.col("rid") == F.col("r2")).withColumn("w", F.least("m", "n"))
    leaks = judged.where(F.col("s") * 100 >= percent * (F.col("m") + F.col("w") - F.col("s")))
    similarity = F.col("s") / (F.col("m") + F.col("w") - F.col("s"))
    named = leaks.join(items.select(F.col("iid").alias("i2"), "item"), F.col("iid") == F.col("i2"))
    start = F.col("start").cast("long")
    return named.select(
        F.col("key").alias(key), "text_hash", F.col("item").alias(item), start.alias("start_word"), (start + F.col("w") + WORDS - 1).alias("end_word"), F.round(similarity, 6).alias("similarity")
    ).distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that leak no item of the benchmark."""
    leaks = find_leaks(docs, benchmark, key, text, **options).select(F.col(key).alias("leak_key_"), F.col("text_hash").alias("leak_hash_")).distinct()
    return docs.join(leaks, docs[key].eqNullSafe(F.col("leak_key_")) & (F.xxhash64(docs[text]) == F.col("leak_hash_")), "left_anti")
