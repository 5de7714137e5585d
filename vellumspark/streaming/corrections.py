"""Streams over the correction log: counts by window, and a trigger at every interval-th manual correction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.sources.layout import CORRECTION


def correction_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CORRECTION).json(path)


def counts_by_window(stream: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Corrections by event-time window and class; what is later than the watermark is left out."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "class").agg(F.count(F.lit(1)).alias("n"))


def retrain_trigger(stream: DataFrame, checkpoint: str, interval: int, start: Callable[[int], None]):
    """Calls start(n) whenever the number of manual corrections passes a multiple n of the interval.

    Each batch's count stands beside the checkpoint under the batch's number, so a restart goes on from there and a batch
    that runs again counts once; start may be called again for such a batch.
    """
    counts = f"{checkpoint}/manual_counts"

    def batch(df: DataFrame, number: int) -> None:
        df.where("source = 'manual'").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        known = df.sparkSession.read.schema("n long, batch long").parquet(counts).where(F.col("batch") <= number)
        before, after = known.agg(F.sum(F.when(F.col("batch") < number, F.col("n")).otherwise(0)), F.sum("n")).first()
        for k in range(before // interval + 1, after // interval + 1):
            start(k * interval)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
