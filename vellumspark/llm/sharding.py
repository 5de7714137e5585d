"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import cut


def _rank(df: DataFrame, bucket: str, group: list[str], order: list, per_bucket: int, out: str) -> DataFrame:
    """Gapless 0-based rank inside each group by (bucket, order).

    Only one bucket of a group meets in a task: counts by bucket are summed up first, and each bucket starts where
    the ones before it end. So a group that holds a third of all rows is ranked by many tasks.
    """
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = F.lit(True)
    left, right = df.alias("l"), starts.alias("r")
    for c in [*group, bucket]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    ranked = left.join(right, on).select("l.*", "r._start")
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    return ranked.withColumn(out, F.col("_start") + F.row_number().over(inside) - 1).drop("_start")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17, per_bucket: int = 20_000) -> DataFrame:
    """Deals rows into `shards` shards whose mixture of sources is that of the whole; law `rows`.

    Rows of each source are put in a seeded random order; the row of rank r among n gets the fraction (r + 1/2) / n;
    all rows are sorted by that fraction and cut into shards whose counts differ by one at most. A source's share of a
    shard is its share of the whole, up to one or two rows. Text is never moved: only its size and checksum are.

    Null text: size 1 and checksum 0. A null source is a source of its own. Equal rows are told apart by nothing and
    take any of the places next to each other. An empty table gives no rows. Extra columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes_"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("source").cast("string").alias("source_"),
    ).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text_crc32", "source_"))
    rows = cut(rows)
    total = rows.count()
    buckets = max(1, -(-total // per_bucket)) * 4
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    order = ["h", "doc_id", "text_crc32"]
    sizes = rows.groupBy("source_").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source_", "of_")
    ranked = _rank(rows, "bucket", ["source_"], order, per_bucket, "r")
    ranked = ranked.join(sizes, F.col("source_").eqNullSafe(F.col("of_"))).drop("of_", "bucket")
    ranked = ranked.withColumn("f", (F.col("r") + 0.5) / F.col("n"))
    ranked = cut(ranked.withColumn("bucket", F.floor(F.col("f") * buckets).cast("int")).withColumn("all_", F.lit(0)))
    placed = _rank(ranked, "bucket", ["all_"], ["f", "h", "doc_id", "text_crc32"], per_bucket, "pos")
    first = lambda s: F.expr(f"({s} * {total}L + {shards - 1}) div {shards}")  # noqa: E731  the first place of a shard
    shard = F.expr(f"cast((pos * {shards}) div {max(total, 1)}L as int)")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        (F.col("bytes_") + 1).alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("pos") - first("shard")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source_").alias("source"),
        F.col("f").alias("fraction"),
    )
