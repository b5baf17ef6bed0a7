"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``: space, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) a local
    one is set; on a cluster executors could not read it, so that is an error.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="codeprism-")
        sc.setCheckpointDir(place)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again.

    Unlike a checkpoint the copy is columnar and compressed, so it suits wide rows
    of which later steps read a few columns.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``limit`` rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if is_small(df, limit) else df


def split_join(rows: DataFrame, facts: DataFrame, on: list[str], hot: int) -> DataFrame:
    """``rows`` joined with ``facts`` (unique by ``on``; n is the number of rows that match).

    Facts of ``hot`` rows or more are broadcast, so no key gathers more rows in a task;
    there are at most as many of them as ``hot`` goes into the number of rows.
    """
    heavy = F.broadcast(facts.where(F.col("n") >= hot))
    light = rows.join(F.broadcast(facts.where(F.col("n") >= hot).select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(light.join(facts.where(F.col("n") < hot), on))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` (null: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the table that ``stored`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/tables/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tables/" in folder and place.split("://")[-1].strip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    It does so when the driver's garbage is collected, which a long run of large jobs
    on a roomy driver may not come to before the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
