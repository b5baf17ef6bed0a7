"""Removal of lines that spread over many sites.

Each line (white space at its ends aside) is keyed by two 64-bit hashes; one
HyperLogLog sketch of its sites per key is merged by aggregation.  Lines whose
estimate lies within the sketch's error of ``min_sites`` get an exact distinct
count; clear ones are decided by the estimate.  A line on ``min_sites`` or more
sites is boilerplate: all its occurrences go but the first (smallest doc_id, then
place), so that the corpus loses no wording.

Only hashes travel; a text is shuffled once, and only in tables where a line goes.
Hot lines meet as partial sketches and, where sites are counted, as distinct sites.
Joins of lines by hash broadcast at most ``BROADCAST_ROWS`` hashes; where there are
more, those with a share of ``HOT_SHARE`` of the removable lines or more are broadcast
(at most 1 / ``HOT_SHARE`` of them) and the others are joined by a shuffle.

Edge cases: null texts stay null and have no lines; blank lines always stay; a null
source is a site of its own; repeated rows are treated alike (both hold the first
occurrence); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import BLANKS, is_small, materialize, split_join

MIN_SITES, LG_K = 8, 12
BROADCAST_ROWS, HOT_SHARE, HOT_ROWS = 200_000, 1 / 2_000, 1_000


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """h1, h2, n (occurrences) and first (the one that stays) of the lines on ``min_sites`` sites or more.

    ``lines`` has h1, h2, site, doc_id, place.  The band for exact counts is five
    standard errors (1.04 / sqrt(2**lg_k)) of the estimate on either side.
    """
    band = 5 * 1.04 / 2 ** (lg_k / 2)
    first = F.min(F.struct("doc_id", "place")).alias("first")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("n"), first)
    spread = sketched.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = int(min_sites * (1 - band)) if min_sites * (1 - band) >= 1 else 1, min_sites * (1 + band)
    likely = materialize(spread.where(F.col("sites") >= low))
    near = likely.where(F.col("sites") <= high)
    sites, wanted = lines.select("h1", "h2", "site"), near.select("h1", "h2")
    if is_small(wanted, broadcast_rows):
        sites = sites.join(F.broadcast(wanted), ["h1", "h2"], "left_semi").distinct()
    else:  # a line's rows are no more than its sites before they meet by hash
        sites = sites.distinct().join(wanted, ["h1", "h2"], "left_semi")
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= min_sites)
    kept = [F.col(c) for c in ("h1", "h2", "n", "first")]
    return likely.where(F.col("sites") > high).select(*kept).unionByName(near.join(exact, ["h1", "h2"]).select(*kept))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the lines removed: columns row (the original), text, n_lines, n_removed."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("key")
    lines = (
        docs.where(F.col("text").isNotNull())
        .select(key, F.coalesce("source", F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
        .select("key", "site", "place", F.btrim("line", F.lit(BLANKS)).alias("line"))
        .where(F.col("line") != "")
        .select("key", F.col("key.doc_id").alias("doc_id"), "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))
    )
    bad = materialize(boilerplate_lines(lines, min_sites, lg_k, broadcast_rows))
    if is_small(bad, broadcast_rows):
        met = lines.join(F.broadcast(bad), ["h1", "h2"])
    else:
        hot = max(HOT_ROWS, int(bad.agg(F.sum("n")).first()[0] * HOT_SHARE))
        met = split_join(lines, bad, ["h1", "h2"], hot)
    places = (
        met
        .where(F.struct("doc_id", "place") != F.col("first"))
        .groupBy("key").agg(F.collect_set("place").alias("places"))
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key)
    out = rows.join(places, rows["key"].eqNullSafe(places["key"]), "left").select("row", F.split("row.text", "\n", -1).alias("all"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    kept = F.expr("CASE WHEN size(places) = 0 THEN row.text ELSE array_join(transform(array_except(sequence(0, size(all) - 1), places), i -> all[i]), '\n') END")
    return out.select("row", kept.alias("text"), F.coalesce(F.when(F.col("row.text").isNotNull(), F.size("all")), F.lit(0)).cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with cleaned texts, same columns; n_chars follows the text where the table has it."""
    out = remove_boilerplate(docs, min_sites, lg_k)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
