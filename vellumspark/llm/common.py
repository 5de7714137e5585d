"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()

#: Settings of Arrow batches: Spark's own values, and those used here.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304"))

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, and bounds Arrow batches by bytes, for long texts.

    Nothing is sent where the workers already see the package (PYTHONPATH). The bounds are settings of the session, which
    lazy results need as well when they run; only those that still have Spark's own values are changed.
    """
    for name, usual, value in BATCHES:
        if spark.conf.get(name) == usual:
            spark.conf.set(name, value)
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in known or app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), "vellumspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in (ROOT / "vellumspark").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def release() -> None:
    """Gives memory that a Python worker has freed, in this task or in those before, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir; in local mode, where it may be unset, one of the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Plans made inside lose their shuffles when they have run."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Runs the plan once and cuts its lineage, into the folder that all executors share.

    The shuffles of that one run go with it: what stands in the shared folder needs them no longer.
    """
    shared_dir(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def rows_of(df: DataFrame) -> list:
    """The rows of a frame whose size has a bound; the run's shuffles go."""
    with _cleaned(df.sparkSession):
        return df.select("*").collect()


def count_of(df: DataFrame) -> int:
    return rows_of(df.agg(F.count(F.lit(1))))[0][0]


def discard(df: DataFrame) -> None:
    """Deletes the folder of a frame from `cut` that no plan reads any longer."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has (Spark compares them without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# Blocked Bloom filter in plain columns: a key's block is one 64-bit word, its bits are chosen inside that word.

BLOOM_BITS = 4


def _bloom_mask(h: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    out = bit(0)
    for k in range(1, BLOOM_BITS):
        out = out.bitwiseOR(bit(k))
    return out


def _bloom_block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(blocks).cast("long")).cast("int")


def bloom_blocks(keys: int, bits_per_key: int = 16, most: int = 1 << 16) -> int:
    """Words for so many keys, `most` (512 KB) at most: beyond that, more keys only mean more false positives."""
    blocks = 64
    while blocks * 64 < keys * bits_per_key and blocks < most:
        blocks *= 2
    return blocks


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> Column:
    """The filter of the long keys (nulls are left out), as a constant array<bigint> of `blocks` words.

    Words are made where the keys are and or-ed by block; only the filter itself, whose size `blocks` fixes, goes
    through the driver. It is a constant, so lambdas may use it, which a subquery's result may not be.
    """
    h = F.col(key)
    filled = keys.where(h.isNotNull()).groupBy(_bloom_block(h, blocks).alias("b")).agg(F.bit_or(_bloom_mask(h)).alias("w"))
    words = np.zeros(blocks, np.int64)
    for b, w in rows_of(filled):
        words[b] = w
    return F.lit(words)


def bloom_may_contain(words: Column, h: Column, blocks: int) -> Column:
    mask = _bloom_mask(h)
    return words[_bloom_block(h, blocks)].bitwiseAND(mask) == mask
