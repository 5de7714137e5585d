"""From raw documents to packed sequences: each stage calls one operator and its result is the next stage's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import decontamination, line_dedup, near_duplicates, packing, toxicity
from vellumspark.llm.common import bloom_blocks, bloom_filter, bloom_may_contain, count_of, cut, fresh, remove, shared_dir, table

#: Words that a worker of the last stage remembers.
PACKING_MEMO = 1 << 18


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; the model learns from the table labels.

    Null and empty texts are scored as texts without words, repeated rows alike; texts of any length go in whole. Without
    labels of both kinds all rows get the mean label (none: 0, so all stay). An empty table gives no rows.
    """
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; those of which nothing is left go.

    n_chars follows the text. Null, empty and short texts stay as they are; null ids come first; rows of equal doc_id and
    text are one document and are treated alike. An empty table gives no rows.
    """
    out = line_dedup.dedup_lines(docs).where("removed_words = 0 or removed_words < n_words")
    return out.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one of the least doc_id (nulls last), and one of several equal rows.

    A row is decided by its own doc_id and text: rows of one doc_id with different texts are documents of their own. For
    that, each row has a number of its own, and the numbers are the keys of the groups. Rows without words (null or empty
    texts among them) are near nothing: of these, only repetitions of doc_id and text go. Of equally good rows any one
    stays. Only rows that may go are moved. An empty table gives no rows.
    """
    n, th = fresh(docs, "n_", "th_")
    rows = cut(docs.withColumns({n: F.monotonically_increasing_id(), th: F.md5(F.col("text").cast("binary"))}))
    groups = near_duplicates.near_duplicate_groups(rows, key=n).select(F.col(n).alias("of"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    known = groups.join(rows.select(n, F.col("doc_id").alias("id"), F.col(th).alias("t")), F.col("of") == F.col(n)).select("of", "group", "id", "t")
    alone = lambda c: F.when(F.col("group").isNull(), F.col(c))
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("t"), F.col("of"))).getField("of").alias("best")
    kept = cut(known.groupBy("group", alone("id").alias("a"), alone("t").alias("b")).agg(best)).select("best")
    gone = cut(rows.select(n).join(kept, F.col(n) == F.col("best"), "left_anti"))
    blocks = bloom_blocks(count_of(gone))
    near = bloom_may_contain(bloom_filter(gone.select(F.xxhash64(n).alias("h")), "h", blocks), F.xxhash64(n), blocks)
    return rows.where(~near).unionByName(rows.where(near).join(gone, n, "left_anti")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table benchmark.

    Null and empty texts, on either side, hold and are nothing; each row is judged by its own doc_id and text. Without
    items all rows stay; an empty table gives no rows.
    """
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; each row is a document of its own, a null or empty text one piece of one id.

    The executors still hold the memory of the stages before, so workers remember fewer words than by themselves.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=PACKING_MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_passages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained trees, signatures and tokenizers are beyond SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result but the last is written to the shared folder and read again.

    A result that the next one has been made from is deleted.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}")
            docs = spark.read.parquet(f"{folder}/{n}")
            if n:
                remove(spark, f"{folder}/{n - 1}")
    return docs
