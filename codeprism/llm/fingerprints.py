"""Document fingerprints as invertible Bloom lookup sketches (DataFrame expressions only).

A text is cut into paragraphs: sentences or lines, of at most 160 code points each.
The 64-bit digests of its distinct paragraphs fill a sketch of cells (count, XOR of
digests, XOR of their check sums), three cells per digest.  Sketches of two versions
are subtracted cell by cell; what they share cancels, and peeling (cells of count one
whose check sum fits give up their digest, which leaves its other cells) recovers the
digests that differ.  Likeness is the Jaccard measure that follows from their number.

A text's fingerprint is its sketch of ``PRINT_CELLS`` cells in hex: count (8 digits),
digests and check sums (16 each).  Likeness subtracts two fingerprints; where these do
not peel off, the digests of the pair are dealt by their low bits to as many sketches as
its size asks for, each of which is made again with twice the cells, up to three times;
what still does not peel is compared digest by digest.

Edge cases: null texts count as empty; two texts without paragraphs have likeness 1;
equal rows are neighbours in order; the only row's next document is itself; a null
doc_id comes last; very long texts count whole; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = r"[^.!?\n]{1,160}[.!?]*\n*|[.!?]+\n*"
#: Cells of a fingerprint, of a sketch at first, and how often it may be made larger.
PRINT_CELLS, FIRST_CELLS, RETRIES = 24, 18, 3
#: Differences that a sketch of ``FIRST_CELLS`` is meant for.
LOAD = 6
#: Ranges of ids at most, rows of a range at least, and bounds that a row is compared with at each of two levels.
RANGES, RANGE_ROWS, FANOUT = 65_536, 2_000, 256
ZERO = "struct(0L AS n, 0L AS k, 0L AS h)"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of ``text``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cells(d: str, cells: int) -> str:
    """SQL fields c0, c1, c2: the cell of digest ``d`` in each third of the sketch."""
    return ", ".join(f"(shiftrightunsigned({d}, {34 + 10 * k}) & 1023) % {cells // 3} AS c{k}" for k in range(3))


def placed(items: str, cells: int) -> str:
    """SQL for the digests of an array with their check sum and their cells."""
    return f"transform({items}, d -> struct(d AS d, xxhash64(d) AS h, {_cells('d', cells)}))"


def sketch(items: str, cells: int) -> str:
    """SQL for the cells of an array of digests."""
    thirds = (
        f"transform(sequence(0, {cells // 3 - 1}), c -> aggregate(ds, {ZERO}, (a, d) -> IF(d.c{k} = c, struct(a.n + 1L AS n, a.k ^ d.d AS k, a.h ^ d.h AS h), a)))"
        for k in range(3)
    )
    return f"aggregate(array({placed(items, cells)}), cast(NULL AS array<struct<n:bigint,k:bigint,h:bigint>>), (z, ds) -> concat({', '.join(thirds)}))"


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> struct(x.n - y.n AS n, x.k ^ y.k AS k, x.h ^ y.h AS h))"


def peeled(cells: str, count: int) -> str:
    """SQL for struct(cells, d): what is left of a subtracted sketch and how many digests it gave up."""
    third = count // 3
    pure = f"array_distinct(transform(filter(st.cells, x -> abs(x.n) = 1 AND x.h = xxhash64(x.k)), x -> struct(x.k AS d, x.h AS h, x.n AS s, {_cells('x.k', count)})))"
    thirds = (
        f"transform(slice(st.cells, {k * third + 1}, {third}), (x, c) -> aggregate(pure, x, (a, p) -> IF(p.c{k} = c, struct(a.n - p.s AS n, a.k ^ p.d AS k, a.h ^ p.h AS h), a)))"
        for k in range(3)
    )
    less = f"concat({', '.join(thirds)})"
    # aggregate over a one-element array names the pure cells for use in both fields
    step = f"""CASE WHEN st.done THEN st ELSE aggregate(array({pure}), st, (s0, pure) ->
        CASE WHEN size(pure) = 0 THEN struct(st.cells AS cells, st.d AS d, true AS done) ELSE struct({less} AS cells, st.d + size(pure) AS d, false AS done) END) END"""
    return f"aggregate(sequence(1, {count}), struct({cells} AS cells, 0 AS d, false AS done), (st, i) -> {step})"


def differing(a: str, b: str) -> str:
    """SQL for the number of digests in just one of the arrays a and b, by sketches of growing size."""
    result = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
    for k in range(RETRIES, -1, -1):
        m = FIRST_CELLS << k
        tried = peeled(subtracted(sketch(a, m), sketch(b, m)), m)
        result = f"aggregate(array({tried}), 0, (z, r) -> CASE WHEN forall(r.cells, x -> x.n = 0 AND x.k = 0) THEN r.d ELSE {result} END)"
    return result


def likeness(a: str, b: str, frame: DataFrame, name: str) -> DataFrame:
    """``frame`` with column ``name``: the likeness of the sketches ``a``_cells and ``b``_cells of the digest arrays a and b."""
    deal = lambda side: f"transform({side}, d -> struct(d & (parts - 1) AS g, d AS d, {1 if side == 'da' else -1} AS s))"
    first = peeled(subtracted(f"{a}_cells", f"{b}_cells"), PRINT_CELLS)
    pair = frame.withColumn("tried", F.expr(f"element_at(transform(array({first}), r -> CASE WHEN forall(r.cells, x -> x.n = 0 AND x.k = 0) THEN r.d END), 1)"))
    # What the fingerprints tell needs no larger sketch.
    pair = pair.withColumns({side: F.when(F.col("tried").isNull(), F.col(x)).otherwise(F.array().cast("array<bigint>")) for side, x in (("da", a), ("db", b))})
    pair = pair.withColumn("parts", F.expr(f"cast(pow(2, ceil(log2(greatest(1, (size(da) + size(db)) / {LOAD}))))  AS bigint)"))
    pair = pair.withColumn("dealt", F.expr(f"sort_array(concat({deal('da')}, {deal('db')}))"))
    pair = pair.withColumn("starts", F.expr("CASE WHEN size(dealt) = 0 THEN cast(array() AS array<int>) ELSE filter(sequence(0, size(dealt) - 1), i -> i = 0 OR dealt[i].g <> get(dealt, i - 1).g) END"))
    side = lambda s: f"transform(filter(grp, x -> x.s = {s}), x -> x.d)"
    group = "slice(dealt, s + 1, coalesce(get(starts, k + 1), size(dealt)) - s)"
    one = f"aggregate(array({group}), 0, (z, grp) -> aggregate(array(struct({side(1)} AS a, {side(-1)} AS b)), 0, (y, v) -> {differing('v.a', 'v.b')}))"
    differ = F.coalesce("tried", F.expr(f"aggregate(transform(starts, (s, k) -> {one}), 0, (x, y) -> x + y)"))
    pair = pair.withColumn("differ", differ)
    both = F.expr(" + ".join(f"aggregate(slice({x}_cells, 1, {PRINT_CELLS // 3}), 0L, (n, c) -> n + c.n)" for x in (a, b)))  # each third counts all digests
    return pair.withColumn("both", both).withColumn(name, F.when(F.col("both") == 0, F.lit(1.0)).otherwise((F.col("both") - F.col("differ")) / (F.col("both") + F.col("differ")))).drop("tried", "da", "db", "parts", "dealt", "starts", "differ", "both")


def shown(cells: str) -> Column:
    """A sketch in hex."""
    return F.array_join(F.transform(F.col(cells), lambda c: F.lower(F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0")))), "")


def range_of(bounds: list, kind: str) -> Column:
    """The number of ``bounds`` (descending) that are doc_id or more, less one; found block by block, then within a block."""
    blocks = [bounds[i : i + FANOUT] for i in range(0, len(bounds), FANOUT)]
    constant = lambda v, t: F.from_json(F.lit(json.dumps(v)), t)  # noqa: E731  a foldable literal, however many bounds
    block = F.size(F.filter(constant([b[0] for b in blocks], f"array<{kind}>"), lambda b: b >= F.col("doc_id")))
    within = F.size(F.filter(F.element_at(constant(blocks, f"array<array<{kind}>>"), block), lambda b: b >= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) - 1)).otherwise((block - 1) * FANOUT + within - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, own (digests), own_cells, and of the next document by descending doc_id (after the last the first) next_text, next and next_cells.

    Rows are dealt to ranges of doc_id whose bounds are ids of the table.  The row at
    a bound also goes to the range above it, as the neighbour of that range's last row.
    """
    rows = docs.count()
    ranges = max(1, min(RANGES, rows // RANGE_ROWS + 8)) if rows else 1
    found = docs.agg(F.percentile_approx("doc_id", F.from_json(F.lit(json.dumps([i / ranges for i in range(1, ranges + 1)])), "array<double>"), F.lit(max(10_000, 20 * ranges))).alias("b"), F.max("doc_id").alias("m")).first()
    bounds = sorted({*(found["b"] or []), *([found["m"]] if found["m"] is not None else [])}, reverse=True)
    at = lambda r, ghost: F.struct(r.alias("r"), F.lit(ghost).alias("ghost"))
    if not bounds:  # only null ids
        guest = F.array(at(F.lit(0), False), at(F.lit(0), True))
    else:
        own = range_of(bounds, dict(docs.dtypes)["doc_id"])
        above = F.when(F.col("doc_id") == bounds[0], F.lit(len(bounds) - 1)).otherwise(own - 1)
        guest = F.when(F.col("doc_id").isin(bounds), F.array(at(own, False), at(above, True))).otherwise(F.array(at(own, False)))
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(guest).alias("at")).select("doc_id", "text", "at.*").repartition("r")
    items = dealt.withColumn("own", digests(F.col("text"))).withColumn("own_cells", F.expr(sketch("own", PRINT_CELLS)))
    order = Window.partitionBy("r").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    after = [F.lead(c).over(order).alias(n) for c, n in (("text", "next_text"), ("own", "next"), ("own_cells", "next_cells"))]
    return items.select("doc_id", "text", "own", "own_cells", "ghost", *after).where(~F.col("ghost")).drop("ghost")


def compare_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    sides = ["own", "own_cells", "next", "next_cells"]
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.select("doc_id", "n_chars", *sides, F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", *sides, F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited"))
    rows = rows.withColumn("edited_cells", F.expr(sketch("edited", PRINT_CELLS)))
    rows = likeness("own", "edited", rows, "near_edited")
    rows = likeness("own", "next", rows, "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", shown("own_cells").alias("fingerprint"), shown("edited_cells").alias("edited_fingerprint"), "near_edited", "near_next")
