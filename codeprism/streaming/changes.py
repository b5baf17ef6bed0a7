"""File-change streams: debounced batches by session windows, and an upsert sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(changes: DataFrame, key: str, time: str, gap: str = "0.5 seconds", late: str = "10 seconds") -> DataFrame:
    """Batches of changes no further apart than ``gap``; works on batch and streaming input alike."""
    if changes.isStreaming:
        changes = changes.withWatermark(time, late)
    return changes.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("w")


def debounced_batch(changes: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """The batch twin of ``debounced`` by gaps and islands."""
    w = Window.partitionBy(key).orderBy(time)
    apart = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > int(gap_seconds * 1e6)
    marked = changes.select(key, time, F.coalesce(apart, F.lit(True)).cast("int").alias("new"))
    return marked.withColumn("batch", F.sum("new").over(w)).groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).drop("batch")


def upsert_into(target: str, key: str = "file_path") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: a Parquet table partitioned by ``key`` in which each batch replaces its files' rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(target)

    return write
