"""Near copies by SimHash over five-word shingles: pigeonring chains propose, the shingle sets decide.

A text is the set of the XXH64 of its five-word shingles (A-Z lower-cased; a shorter
text is one shingle).  Texts of equal sets are one node.  At a Jaccard measure of 0.8
about 15 % of the bits of two SimHash fingerprints differ, too many for 64 bits to tell,
so prints are wide: a ring of segments of b bits, b about log2 of the number of texts.
As ``SEGMENTS`` are as many as it takes for one of them to be equal with probability
``RECALL`` at 0.8, their number grows with the number of texts to the power 0.24.

1. Nodes that have a segment in common meet.  From there on the chain of the next 128
   bits must keep within proportional budgets (``BUDGET`` of the bits so far, at every
   step of 32), or the pair is dropped.  What is left must pass the full Hamming check.
2. Pairs that pass fall into proposed components.  Within one, nodes at ``JACCARD`` or
   more by their sets are linked; these components are the result.

A place where some ``CROWD`` nodes or more meet is not searched: all of them are proposed
together.  Such places show in one node of ``CROWD_SAMPLE``; whichever way a place goes, the
sets decide.  A proposed component of more than ``CROWD`` nodes or
``CROWD_HASHES`` hashes is dealt to blocks.  A few of its nodes are compared with all
blocks, then some of those outside the largest component so far, then all of these; so
every link that could still join two components is seen, and none within the largest.

Edge cases: null and empty texts have the empty set and are copies of each other;
repeated rows are members like any other; a null doc_id counts as larger than all
others; very long texts count whole; an empty table gives an empty result; extra
columns pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.llm.common import broadcast_if_small, discard, materialize, release, stored
from codeprism.llm.simhash import components, shingles

SHINGLE, JACCARD, RECALL, BUDGET = 5, 0.8, 0.98, 0.25
#: Share of equal bits of two sets of one size at ``JACCARD``: their cosine is 2J / (1 + J).
AGREE = 1 - math.acos(2 * JACCARD / (1 + JACCARD)) / math.pi
#: Bits of a segment at least, and bits of a chain.
LEAST_BITS, CHAIN = 12, 128
#: Nodes of a place that are compared pair by pair at once; larger places by a spanning forest.
PAIRWISE = 8
CROWD, CROWD_HASHES = 2_000, 2_000_000
#: One node of so many tells which places are crowded, by half the nodes expected of a crowd.
CROWD_SAMPLE = 64
#: Nodes of a crowded component that are compared with all its blocks in the first two rounds.
PIVOTS = (8, 64)
BROADCAST_ROWS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def layout(texts: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for so many texts; the ring is a multiple of 64 bits."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, texts))))
    segments = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**bits))
    return bits, -(-segments * bits // 64) * 64 // bits


def wide_print(values: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of hashes in ``words`` of 64 bits: each bit is 1 if set in over half of them."""
    seeds = (np.arange(1, words + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(values), 240):  # sums of so few fit a byte
        h = values[at : at + 240, None] * seeds
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(values), bitorder="little").view(np.int64)


def signed(sets: DataFrame, words: int) -> DataFrame:
    """key, node, size and print (words of 64 bits; none for the empty set) of rows with k0 and hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, values = np.asarray(b["hashes"].offsets), np.asarray(b["hashes"].values).view(np.uint64)
            nodes, sizes, prints = [], [], []
            for start, end in zip(ends[:-1], ends[1:]):
                one = np.unique(values[start:end])
                nodes.append(int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(one))
                prints.append(wide_print(one, words) if len(one) else np.zeros(0, np.int64))
            arrays = [b["k0"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "size", "print"])

    return sets.mapInArrow(sign, f"key {dict(sets.dtypes)['k0']}, node long, size long, print array<long>")


def ring(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each print (a row of words) the segments (with their number) and the ``CHAIN`` bits from each on, as words."""
    raw = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    number = raw.shape[1] // bits
    turned = np.concatenate([raw, raw[:, : bits + CHAIN]], axis=1)
    at = np.arange(number) * bits
    keys = np.zeros((len(prints), number), np.uint64)
    for k in range(bits):
        keys = keys << np.uint64(1) | turned[:, at + k]
    keys = (keys * np.uint64(number) + np.arange(number, dtype=np.uint64)).view(np.int64)
    chain = turned[:, (at[:, None] + bits + np.arange(CHAIN))]
    return keys, np.packbits(chain, axis=2, bitorder="little").view(np.int64)


def places(nodes: DataFrame, bits: int) -> DataFrame:
    """node, place, c0, c1 (the chain) for every segment of every node."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                prints = part["print"].flatten().to_numpy(zero_copy_only=False)
                if not len(prints):
                    continue
                keys, chain = ring(prints.reshape(part.num_rows, -1), bits)
                columns = [np.repeat(part["node"].to_numpy(), keys.shape[1]), keys.ravel(), chain[..., 0].ravel(), chain[..., 1].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "place", "c0", "c1"])

    return nodes.where(F.size("print") > 0).select("node", "print").mapInArrow(lay, "node long, place long, c0 long, c1 long")


def chained(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether the chains a and b (rows of two words) keep within the budgets at every step of 32 bits."""
    steps = np.bitwise_count((a ^ b).view(np.uint32)).cumsum(axis=-1)
    return (steps <= BUDGET * (bits + 32 * np.arange(1, CHAIN // 32 + 1))).all(axis=-1)


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """Runs of whole groups of rows of equal ``columns``; the rows are sorted by them."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b[c]) for c in columns])
        other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and rest and all(rest[-1][c][-1].as_py() == k[0] for c, k in zip(columns, keys)):
            rest.append(b)
            continue
        if cut or rest:
            yield pa.Table.from_batches([*rest, *([b.slice(0, cut)] if cut else [])])
        rest = [b.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each run of equal keys."""
    cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys[0])]])


def _forest(node: np.ndarray, chain: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links of the nodes of one place by their chains."""
    found, root = [], np.arange(len(node))
    for i in range(len(node) - 1):
        rest = np.flatnonzero(root != root[i])
        alike = rest[chained(chain[rest], chain[i], bits)]
        others, first = np.unique(root[alike], return_index=True)
        found += [(node[i], node[alike[k]]) for k in first]
        root[np.isin(root, others)] = root[i]
        if len(rest) == len(alike):
            break
    return found


def proposed(nodes: DataFrame, bits: int) -> DataFrame:
    """Links a, b between nodes that share a segment, keep within the chain's budgets and pass the full check."""
    met = places(nodes, bits)
    some = places(nodes.where(F.pmod(F.xxhash64("node"), F.lit(CROWD_SAMPLE)) == 0), bits)
    crowds = some.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where(2 * CROWD_SAMPLE * F.col("n") > CROWD)
    crowds = broadcast_if_small(materialize(crowds.select("place", "hub")), BROADCAST_ROWS)
    together = met.join(crowds, "place").where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    dealt = met.join(crowds, "place", "left_anti").repartition("place").sortWithinPartitions("place")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "place"):
            place, node = t["place"].to_numpy(), t["node"].to_numpy()
            chain = np.stack([t["c0"].to_numpy(), t["c1"].to_numpy()], axis=1)
            start, end = _bounds(place)
            size = np.repeat(end - start, end - start)
            pairs = []
            for k in range(1, PAIRWISE):
                i = np.flatnonzero((place[k:] == place[:-k]) & (size[k:] <= PAIRWISE))
                i = i[chained(chain[i], chain[i + k], bits)]
                pairs.append(np.stack([node[i], node[i + k]]))
            for s, e in zip(start, end):
                if e - s > PAIRWISE and (found := _forest(node[s:e], chain[s:e], bits)):
                    pairs.append(np.array(found, np.int64).T)
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    links = dealt.mapInArrow(meet, "a long, b long").distinct()
    prints = nodes.select("node", "print")
    full = links.join(prints.select(F.col("node").alias("a"), F.col("print").alias("pa")), "a").join(prints.select(F.col("node").alias("b"), F.col("print").alias("pb")), "b")
    differ = F.expr(f"aggregate(zip_with(pa, pb, (x, y) -> bit_count(x ^ y)), 0, (s, d) -> s + d) <= {BUDGET} * 64 * size(pa)")
    return full.where(differ).select("a", "b").unionByName(together)


class Sets:
    """An inverted index over some sets, for the Jaccard measure of others with them."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.values, value = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.held = owner[np.argsort(value, kind="stable")]
        self.bound = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=len(self.values)))])

    def near(self, one: np.ndarray, jaccard: float = JACCARD) -> np.ndarray:
        """Places of the sets at ``jaccard`` or more from ``one``."""
        at = np.searchsorted(self.values, one)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == one)] if len(self.values) else at[:0]
        first, n = self.bound[at], self.bound[at + 1] - self.bound[at]
        spots = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        shared = np.bincount(self.held[spots], minlength=len(self.size))
        return np.flatnonzero(shared >= jaccard * (self.size + len(one) - shared) - 1e-9)


def joined(sets: list[np.ndarray], jaccard: float = JACCARD) -> np.ndarray:
    """The component of each set, as the place of one member: sets at ``jaccard`` or more are linked."""
    index, root = Sets(sets), np.arange(len(sets))
    for i, one in enumerate(sets[:-1]):
        root[np.isin(root, root[index.near(one, jaccard)])] = root[i]
        if (root == root[0]).all():
            break
    return root


def decided(sets: DataFrame) -> DataFrame:
    """Links a, b (each node to the smallest of its component) within small proposed components: proposed, node, hashes."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "proposed"):
            node, out, hashes = t["node"].to_numpy(), [], t["hashes"].combine_chunks()
            for start, end in zip(*_bounds(t["proposed"].to_numpy())):
                ids, at = np.unique(node[start:end], return_index=True)  # a repeated row has its node again
                if len(ids) > 1:
                    root = joined([np.unique(hashes[int(start + k)].values.to_numpy()) for k in at])
                    least = np.full(len(ids), len(ids))
                    np.minimum.at(least, root, np.arange(len(ids)))
                    out.append((ids, ids[least[root]]))
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    flat = sets.select("proposed", "node", "hashes").repartition("proposed").sortWithinPartitions("proposed")
    return flat.mapInArrow(decide, "a long, b long").where("a <> b")


def compared(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Links a, b between ``queries`` and the ``members`` (proposed, block, blocks, node, hashes) of their proposed component.

    Every query goes to every block; a block holds its members and takes the queries one by one.
    """
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = members.select("proposed", "block", F.lit(0).alias("asks"), "node", "hashes").unionByName(asked.select("proposed", "block", F.lit(1).alias("asks"), "node", "hashes"))
    dealt = both.repartition("proposed", "block").sortWithinPartitions("proposed", "block", "asks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, index = None, [], [], None
        for b in batches:
            hashes, a, links = b["hashes"], [], []
            for i, row in enumerate(zip(*(b[c].to_pylist() for c in ("proposed", "block", "asks", "node")))):
                if row[:2] != at:
                    at, ids, sets, index = row[:2], [], [], None
                one = np.unique(hashes[i].values.to_numpy())
                if not row[2]:
                    ids.append(row[3])
                    sets.append(one)
                    continue
                index = index or (Sets(sets) if sets else None)
                for k in index.near(one) if index else ():
                    if ids[k] != row[3]:
                        a.append(row[3])
                        links.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(links, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(ask, "a long, b long")


def dissolved(members: DataFrame) -> DataFrame:
    """Links a, b within crowded proposed components, enough to tell their components: proposed, block, blocks, node, hashes."""
    links = None
    for pivots in (*PIVOTS, None):
        label = members.select("proposed", "node")
        if links is not None:
            roots = components(links)
            label = label.join(roots, "node", "left").select("proposed", "node", F.coalesce("root", "node").alias("root"))
            sizes = label.groupBy("proposed", "root").agg(F.count(F.lit(1)).alias("n"))
            largest = sizes.groupBy("proposed").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
            label = label.join(largest, "proposed").where(F.col("root") != F.col("largest"))
        outside = members.join(materialize(label.select("node")), "node")
        if pivots is not None:
            rank = F.row_number().over(Window.partitionBy("proposed").orderBy("node"))
            chosen = materialize(outside.select("proposed", "node").withColumn("n", rank).where(F.col("n") <= pivots).select("node"))
            outside = members.join(chosen, "node")
        found = stored(compared(members, outside))
        links = found if links is None else stored(links.unionByName(found).distinct())
    return links


def labelled(docs: DataFrame, key: Column, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """key and node of every row; node, root (of its component) and first (smallest key) of every node."""
    bits, segments = layout(docs.count())
    prints = stored(signed(shingles(docs, key, shingle=shingle), -(-segments * bits // 64)))
    nodes = stored(prints.groupBy("node").agg(F.min("key").alias("first"), F.first("size").alias("size"), F.first("print").alias("print")))
    loose = materialize(components(proposed(nodes, bits)).select(F.col("node"), F.col("root").alias("proposed")))
    loose = loose.unionByName(loose.select(F.col("proposed").alias("node"), "proposed").distinct()).distinct()
    release(docs.sparkSession)
    wanted = materialize(nodes.join(loose, "node").select("first", "node", "proposed", "size"))
    crowds = wanted.groupBy("proposed").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    blocks = F.when((F.col("n") > CROWD) | (F.col("hashes") > CROWD_HASHES), F.ceil(F.greatest(F.col("n") / CROWD, F.col("hashes") / CROWD_HASHES))).otherwise(0)
    crowds = materialize(crowds.select("proposed", blocks.cast("long").alias("blocks")).where(F.col("blocks") > 0))
    placed = wanted.join(broadcast_if_small(crowds, BROADCAST_ROWS), "proposed", "left").select("first", F.struct("proposed", "node", F.coalesce("blocks", F.lit(0)).alias("blocks")).alias("at"))
    texts = docs.select("text", key.alias("key"))
    texts = texts.join(placed, texts["key"] == placed["first"]).select("text", "at")
    sets = shingles(texts, F.col("at"), shingle=shingle).select("k0.*", "hashes")
    links = decided(sets.where("blocks = 0"))
    if crowds.limit(1).count():
        members = stored(sets.where("blocks > 0").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).dropDuplicates(["node"]))
        links = links.unionByName(dissolved(members))
    named = nodes.select("node", "first").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("node", "root", "first"))
    discard(nodes)
    release(docs.sparkSession)
    return prints.select("key", "node"), named


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The row of the smallest doc_id (nulls last, then text hash) of each component, with all columns of ``docs``."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    firsts = labelled(docs, key, shingle)[1].groupBy("root").agg(F.min("first").alias("first"))
    release(docs.sparkSession)
    # Keys are never null (their fields may be) and of one type, so a plain join deals the rows as the window wants them.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.cast(firsts.schema["first"].dataType).alias("key"))
    kept = rows.join(firsts, rows["key"] == firsts["first"], "left_semi")
    once = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return kept.withColumn("n", once).where(F.col("n") == 1).select("row.*")
