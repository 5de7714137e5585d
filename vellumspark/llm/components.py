"""Connected components of a link table, without the links ever leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import count_of, cut, discard, rows_of

#: A vertex with more links than this, and than one in HOT_SHARE of all, is dealt out to SALTS tasks.
HOT, HOT_SHARE, SALTS = 50_000, 10_000, 64
#: Links that a partition of a round's result holds, and the least number of partitions.
PER_PARTITION, PARTITIONS = 500_000, 8


def _with_least(edges: DataFrame, hot: list[int]) -> DataFrame:
    """The links with m, the least neighbour of u; repeated links are left out.

    A vertex's links come in order of the neighbour, so its least one is the first: a task holds no neighbourhood. The
    links of hot vertices, of which there are 2 x HOT_SHARE at most, are dealt out, and their least ones are summed up.
    """
    if hot:
        is_hot = F.col("u").isin(hot)
        edges = edges.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0)))
        summed = edges.where(is_hot).groupBy("u").agg(F.min("v").alias("low"))
        edges = edges.join(F.broadcast(summed), "u", "left")
    else:
        edges = edges.withColumns({"salt": F.lit(0), "low": F.lit(None).cast("long")})
    by = Window.partitionBy("u", "salt").orderBy("v")
    first = F.min("v").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return edges.select("u", "v", F.coalesce("low", first).alias("m"), F.lag("v").over(by).alias("b")).where("b is null or b <> v").drop("b")


def _round(edges: DataFrame, hot: list[int]) -> DataFrame:
    """Large star, then small star: each vertex hands the least of its neighbourhood to its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    small = _with_least(large, hot)
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _neighbours(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the long pairs (u, v); component is the least vertex reachable.

    Null ends and loops are left out. Rounds go on until all links are stars about their least vertex; each writes its
    links to the shared folder, so a lost executor costs one round at most, and the folder of the round before goes. A
    round deals its links out twice, and its test sums up by vertex.
    """
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    rows = count_of(now)
    while True:
        limit = max(HOT, rows // HOT_SHARE)
        open_ = (F.col("lo") < F.col("u")) & (F.col("lo") < F.col("hi"))
        # at most 2 x HOT_SHARE vertices have so many links
        left, rows, hot = rows_of(_neighbours(now).agg(F.count_if(open_), F.sum("n"), F.collect_list(F.when(F.col("n") > limit, F.col("u")))))[0]
        if not left:
            break
        rows //= 2
        before, now = now, cut(_round(now, hot).coalesce(max(PARTITIONS, rows // PER_PARTITION)))
        discard(before)
    return _neighbours(now).select(F.col("u").alias("vertex"), F.least("u", "lo").alias("component"))
