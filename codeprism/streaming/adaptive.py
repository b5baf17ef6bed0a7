"""A workspace's change stream with a quiet time that follows how long its checks take.

A file's changes are one batch as long as they come closer together than its quiet time:
twice what its last check took, between ``LEAST`` and ``MOST`` seconds, ``FIRST`` before any
check.  Events are changes (took is null) and reports of checks (took in seconds).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Quiet time in seconds: before any check, at least and at most; and how many times a check's own time.
FIRST, LEAST, MOST, TIMES = 0.6, 0.3, 3.0, 2.0
BATCH = "n long, first timestamp, last timestamp"


def watched(spark: SparkSession, folder: str, pattern: str = "*.bsl") -> DataFrame:
    """Changes (path, ts) of the files below ``folder`` as a stream: each new or rewritten file is one."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("ts"))


def quiet(took: Column) -> Column:
    return F.when(took.isNull(), F.lit(FIRST)).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), took * TIMES)))


def batches(events: DataFrame, key: str = "path", time: str = "ts", unit: float = 1.0) -> DataFrame:
    """key, n, first and last of every batch of changes, by windows; the batch twin of ``adaptive_batches``.

    ``unit`` is the number of seconds of a unit of quiet time, for events that are sparser than a workspace's.
    """
    order = Window.partitionBy(key).orderBy(time, F.col("took").isNull())
    known = events.select(key, F.col(time).cast("timestamp").alias("t"), "took", quiet(F.last("took", ignorenulls=True).over(order)).alias("quiet")).where("took IS NULL")
    by = Window.partitionBy(key).orderBy("t")
    apart = F.unix_micros("t") - F.unix_micros(F.lag("t").over(by)) > F.lag("quiet").over(by) * (unit * 1_000_000)
    marked = known.withColumn("batch", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    return marked.groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).drop("batch")


STATE = "n long, first long, last long, gap long, known long"


def adaptive_batches(events: DataFrame, key: str = "path", time: str = "ts", late: str = "10 seconds") -> DataFrame:
    """``batches`` over a stream: a key's open batch and quiet time are state; a batch ends with the next one or when its quiet time has passed.

    Events of one trigger are taken in order of time; one that is older than the open
    batch's last change counts to that batch, one later than ``late`` is not seen.
    """

    def step(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, gap, known = state.get if state.exists else (0, 0, 0, int(FIRST * 1e6), int(FIRST * 1e6))
        out = []
        if state.hasTimedOut:
            out.append((n, first, last))
            n = 0
        else:
            rows = pd.concat(list(frames))
            rows = rows.assign(change=rows["took"].isna()).sort_values(["t", "change"], kind="stable")
            for t, took, change in zip(rows["t"].tolist(), rows["took"].tolist(), rows["change"].tolist()):
                if not change:
                    known = int(min(MOST, max(LEAST, took * TIMES)) * 1e6)
                    continue
                if n and t - last > gap:
                    out.append((n, first, last))
                    n = 0
                gap = known
                first, last, n = (min(first, t), max(last, t), n + 1) if n else (t, t, 1)
        state.update((n, first, last, gap, known))
        if n:
            state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            done = pd.DataFrame(out, columns=["n", "first", "last"])
            yield pd.DataFrame({key: [names[0]] * len(done), "n": done["n"], "first": pd.to_datetime(done["first"], unit="us"), "last": pd.to_datetime(done["last"], unit="us")})

    timed = events.select(key, F.col(time).cast("timestamp").alias("at"), F.col("took").cast("double").alias("took")).withWatermark("at", late).withColumn("t", F.unix_micros("at"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {dict(events.dtypes)[key]}, {BATCH}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
