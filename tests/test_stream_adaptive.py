"""The adaptive change stream against its batch twin, trigger by trigger."""

import random

from pyspark.sql import functions as F

from codeprism.streaming import adaptive

SCHEMA = "path string, ts timestamp, took double"


def events(rows, spark):
    return spark.createDataFrame(rows, "path string, s double, took double").select("path", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "took")


def found(df):
    return sorted((r["path"], r["n"], r["first"], r["last"]) for r in df.collect())


def test_quiet_time_follows_checks(spark):
    rows = [("a", 0.0, None), ("a", 0.5, None), ("a", 1.2, None), ("a", 1.3, 1.0), ("a", 1.4, None), ("a", 3.3, None), ("a", 3.4, 0.01), ("a", 5.2, None), ("a", 5.6, None), ("a", 6.0, 9.0), ("b", 0.0, 0.1)]
    got = [(p, n, f.timestamp(), z.timestamp()) for p, n, f, z in found(adaptive.batches(events(rows, spark)))]
    assert got == [("a", 1, 5.6, 5.6), ("a", 2, 0.0, 0.5), ("a", 4, 1.2, 5.2)]


def test_stream_equals_its_twin(spark, tmp_path):
    random.seed(8)
    rows, clock = [], {k: 0.0 for k in "abc"}
    for _ in range(120):
        k = random.choice("abc")
        clock[k] += random.choice([0.1, 0.35, 0.5, 0.7, 1.5, 4.0])
        rows.append((k, round(clock[k], 3), random.choice([None, None, None, 0.05, 0.4, 2.0])))
    rows.sort(key=lambda r: r[1])
    parts = [rows[i : i + 30] for i in range(0, 120, 30)] + [[(k, 1000.0, None) for k in "abc"], [(k, 2000.0, None) for k in "abc"]]
    for i, part in enumerate(parts):
        events(part, spark).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = adaptive.adaptive_batches(source, late="60 seconds").writeStream.outputMode("append").format("memory").queryName("adaptive").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    twin = found(adaptive.batches(events([r for p in parts[:-1] for r in p], spark)))
    assert found(spark.table("adaptive").where("first < timestamp_seconds(1500)")) == twin


def test_watched_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.bsl").write_text("A = 1;")
    (tmp_path / "src/b.txt").write_text("no")
    query = adaptive.watched(spark, str(tmp_path / "src")).writeStream.format("memory").queryName("watched").start()
    query.processAllAvailable()
    (tmp_path / "src/c.bsl").write_text("B = 1;")
    query.processAllAvailable()
    query.stop()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.table("watched").collect()) == ["a.bsl", "c.bsl"]
