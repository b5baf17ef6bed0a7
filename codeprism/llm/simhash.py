"""SimHash fingerprints linked by pigeonring filtering, and connected components.

A fingerprint has a bit set if more than half of a text's word shingles have it set in
their XXH64.  Documents of equal fingerprints are one node.  The 64 bits lie on a ring
of three segments (22, 21, 21 bits).  If two fingerprints differ in at most two bits,
some segment starts a chain whose running sums of differences stay within the
proportional budgets 2/3, 4/3, 6/3: the segment itself is equal, with the next one the
sum is at most 1, with the third at most 2.  So each fingerprint is filed under the
segment and the next one as they are, and probes with the next one's bits flipped one
at a time; only fingerprints that meet so are compared in full.

A place where fingerprints meet holds equal bits in two segments, so it has at most
2**22 members and those differ only in the third.  Small ones are compared pairwise;
larger ones through shared neighbours in the third segment, in time linear in their
size; either way a place returns a spanning forest of its links, not all pairs.
Components come from tasks that settle a bounded number of links each and, where one
task does not hold them all, alternating large-star and small-star steps over checkpoints.

Edge cases: null and empty texts have fingerprint zero and are linked like any other;
repeated rows are members like any other; a null doc_id counts as larger than all
others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.llm.common import lower_ascii, materialize, words_of

SHINGLE, MAX_BITS = 3, 2
#: Places with more members than this are linked through neighbours instead of pairwise.
PAIRWISE = 256
#: Segments of the ring as (lowest bit, bits); segment i is followed by i + 1.
RING = ((0, 22), (22, 21), (43, 21))
#: Links that one task settles by itself (16 bytes each).
TASK_LINKS = 1_000_000


def shingles(docs: DataFrame, *keys: Column, shingle: int = SHINGLE) -> DataFrame:
    """``keys`` as k0, k1... and hashes, the XXH64 of all word shingles of column text."""
    names = [f"k{i}" for i in range(len(keys))]
    words = docs.select(*(k.alias(n) for k, n in zip(keys, names)), words_of(lower_ascii(F.coalesce("text", F.lit("")))).alias("words"))
    parts = ", ' ', ".join(f"words[i + {j}]" for j in range(shingle))
    return words.select(
        *names,
        F.expr(f"""CASE WHEN size(words) = 0 THEN cast(array() AS array<bigint>)
                        WHEN size(words) < {shingle} THEN array(xxhash64(array_join(words, ' ')))
                        ELSE transform(sequence(0, size(words) - {shingle}), i -> xxhash64(concat({parts}))) END""").alias("hashes"),
    )


def fingerprints(docs: DataFrame, *keys: Column, shingle: int = SHINGLE) -> DataFrame:
    """``keys`` as k0, k1... and the signed 64-bit fingerprint of column text."""
    names = [f"k{i}" for i in range(len(keys))]
    hashes = shingles(docs, *keys, shingle=shingle)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["hashes"]
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint8)
            out = np.zeros(b.num_rows, np.int64)
            for i, (start, end) in enumerate(zip(ends[:-1], ends[1:])):
                ones = np.zeros(64, np.int64)
                for at in range(start, end, 1 << 16):  # bounded memory for very long texts
                    bits = np.unpackbits(values[8 * at : 8 * min(end, at + (1 << 16))], bitorder="little").reshape(-1, 64)
                    ones += bits.sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > end - start, bitorder="little").view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(out)], [*names, "fingerprint"])

    kinds = dict(hashes.dtypes)
    return hashes.mapInArrow(vote, ", ".join(f"{n} {kinds[n]}" for n in names) + ", fingerprint long")


def _forest(own: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one place: ``own`` are filed there, ``probes`` one flipped bit away."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    links = []

    def link(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((x, y))

    if len(own) * (len(own) + len(probes)) <= PAIRWISE * PAIRWISE:
        both = np.concatenate([own, probes])
        for i, x in enumerate(own):
            near = np.bitwise_count((both[i + 1 :] ^ x).view(np.uint64)) <= MAX_BITS
            for y in both[i + 1 :][near]:
                link(int(x), int(y))
        return links
    ball: dict[int, int] = {}
    masks = [0, *(1 << i for i in range(64))]
    for x in map(int, own):  # fingerprints two bits apart share a neighbour one bit away from both
        for m in masks:
            y = x ^ m if m != 1 << 63 else x ^ -(1 << 63)
            link(x, ball.setdefault(y, x))
    for x in map(int, probes):
        for m in masks:
            y = x ^ m if m != 1 << 63 else x ^ -(1 << 63)
            if y in ball:
                link(x, ball[y])
    return links


def links(nodes: DataFrame) -> DataFrame:
    """Links a, b that join distinct values of column fingerprint at ``MAX_BITS`` bits or fewer."""

    def filed(i: int) -> list[Column]:
        (at, bits), (to, more) = RING[i], RING[(i + 1) % 3]
        mask = ((1 << bits) - 1) << at | ((1 << more) - 1) << to
        mask -= (mask >> 63) << 64
        key = F.col("fingerprint").bitwiseAND(F.lit(mask))
        flips = [1 << b if b < 63 else -(1 << 63) for b in range(to, to + more)]
        own = F.struct(F.lit(i).alias("i"), key.alias("key"), F.lit(0).alias("probe"))
        return [own, *(F.struct(F.lit(i).alias("i"), key.bitwiseXOR(F.lit(f)).alias("key"), F.lit(1).alias("probe")) for f in flips)]

    places = nodes.select("fingerprint", F.inline(F.array(*[x for i in range(3) for x in filed(i)])))
    # A place without a filed fingerprint, or with one alone, links nothing.
    dealt = places.repartition("i", "key").sortWithinPartitions("i", "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        empty = np.zeros(0, np.int64)

        def emit(i, key, probe, fp):
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            filed_here = np.add.reduceat(1 - probe, starts) if len(key) else empty
            out = []
            for k in np.flatnonzero((filed_here > 0) & (ends - starts > 1)):
                p, f = probe[starts[k] : ends[k]], fp[starts[k] : ends[k]]
                out += _forest(f[p == 0], f[p == 1])
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            now = [np.asarray(batch[c]) for c in ("i", "key", "probe", "fingerprint")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            i, key = now[0], now[1]
            last = np.flatnonzero((key != key[-1]) | (i != i[-1])) if len(key) else empty
            at = int(last[-1]) + 1 if len(last) else 0
            rest = [x[at:] for x in now]
            if at:
                yield emit(*(x[:at] for x in now))
        if rest is not None and len(rest[0]):
            yield emit(*rest)

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links a, b of every node of a part's links to the smallest node of its component there."""
    parts = [(np.asarray(x["a"]), np.asarray(x["b"])) for x in batches if x.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        low, high = np.minimum(root[a[apart]], root[b[apart]]), np.maximum(root[a[apart]], root[b[apart]])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    more = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(nodes[root[more]])], ["a", "b"])


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """node, root of every node (long) that is not the smallest of its component, which is root; links are a, b.

    Tasks of about ``task_links`` links first settle theirs, each by itself.  Where one task holds all
    that is left this ends; otherwise large-star and small-star steps follow until a round changes
    nothing; labels only fall, so this ends.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before, parts = state, max(1, -(-state["n"] // task_links))
        edges = materialize(edges.coalesce(parts).mapInArrow(_settled, "a long, b long"))
        if parts == 1:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where(F.col("a") != F.col("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(prints: DataFrame, doc: str) -> DataFrame:
    """``prints`` (doc, fingerprint, ...) with component_id, the smallest ``doc`` reachable over links."""
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min(doc).alias("first")))
    roots = components(links(nodes))
    labelled = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    named = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    names = labelled.join(named, "root").select("fingerprint", "component_id")
    return prints.join(names, "fingerprint")


def group_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs, F.col("doc_id"), shingle=shingle).withColumnRenamed("k0", "doc_id"))
    return grouped(prints, "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The row of the smallest doc_id (nulls last, then text hash) of each component, with all columns of ``docs``."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    prints = materialize(fingerprints(docs, key, shingle=shingle).withColumnRenamed("k0", "key"))
    firsts = grouped(prints, "key").select(F.col("component_id").alias("first")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    kept = rows.join(firsts, rows["key"].eqNullSafe(firsts["first"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return kept.withColumn("n", once).where(F.col("n") == 1).select("row.*")
