"""Removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every window of ``length`` bytes that also starts anywhere else, in the same document
or another, is removed; overlaps count, and windows are judged on the input.

1. Anchors.  The smallest hash among a window's 16-byte strings marks its anchor, so
   equal windows have their anchor at the same offset.  Windows next to each other with
   one anchor and offsets of one class form a context; all of them hold the same core of
   over 200 bytes, whose hash is the key under which equal windows must meet.
2. Contexts whose key occurs once hold no repeat.  A context's identity is a BLAKE2b
   digest of 128 bits over its bytes and its anchor's offset.
   Where all contexts of a key are equal by it, all their windows repeat.  The others
   are gathered, each distinct one once.
3. Per block of contexts a Burrows-Wheeler transform is built and expanded: breadth
   first, all intervals of strings of length l are extended backward by one byte, and
   each right boundary reached for the first time has l as its common prefix.  The
   walk stops at ``length``; boundaries never reached separate equal windows.
4. A key with very many distinct contexts is dealt to several blocks.  There the hashes
   of windows unique in their block, and of one window of each repeat, meet by
   aggregation to find repeats across blocks.

Keys and contexts with a share of all rows (at most 1 / ``HOT_SHARE`` of them) are joined
by broadcast, the others by a shuffle.  Texts travel twice (contexts out, spans back), never grouped by passage.

Edge cases: null and empty texts have nothing to remove; texts shorter than ``length``
stay; equal rows repeat each other; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import materialize, split_join, stored

LENGTH = 400
GRAM = 16
#: Distinct contexts of one key that a block takes; more are dealt to several.
BLOCK_CONTEXTS = 2048
#: A key or context is hot with this share of all rows; so few of them exist that they can be broadcast.
HOT_SHARE, HOT_ROWS = 1 / 2_000, 1_000
#: Bytes of contexts that a judging task takes, about.
TASK_BYTES = 8_000_000
#: Bytes of contexts that one transform covers, and documents' bytes hashed at once.
BLOCK_BYTES, SEGMENT = 1_500_000, 4_000_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class RollingHash:
    """Hashes of all substrings of a byte array from two prefix sums."""

    _cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = 1 << max(16, (len(data) + 1).bit_length())
        known = self._cache.get(int(base))
        if known is None or len(known[0]) < len(data) + 1:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            known = self._cache[int(base)] = _powers(base, n), _powers(inverse, n)
        self.up, self.down = known
        self.sums = np.zeros(len(data) + 1, np.uint64)
        mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        np.cumsum((mixed ^ (mixed >> np.uint64(29))) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    n = len(data) - GRAM + 1
    words = np.empty(n + 8, np.uint64)
    raw = np.concatenate([data, np.zeros(16, np.uint8)])
    for k in range(8):
        part = words[k::8]
        part[:] = raw[k : k + 8 * len(part)].view(np.uint64)
    h = words[:n] * _B1 ^ (words[8 : n + 8] * _B2 >> np.uint64(7))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, ~np.uint64(0))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def contexts_of(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, ctx and ctx2 (the halves of its digest), first and last window start of every context of one text."""
    width = length - GRAM + 1
    half = -(-width // 2)
    parts = []
    for at in range(0, max(1, len(data) - length + 1), SEGMENT):  # a segment has the windows that start in it
        piece = data[at : at + SEGMENT + length - 1]
        if len(piece) < length:
            break
        mask = np.uint64((1 << 24) - 1)
        grams = _gram_hashes(piece) & ~mask
        anchor = (_sliding_min(grams | np.arange(len(grams), dtype=np.uint64), width) & mask).astype(np.int64)
        offset_class = (anchor - np.arange(len(anchor))) // half
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (offset_class[1:] != offset_class[:-1])) + 1
        lo = np.concatenate([[0], change])
        hi = np.concatenate([change, [len(anchor)]]) - 1
        p, c = anchor[lo], offset_class[lo]
        core = np.maximum(p - c * half, 0), np.minimum(p - (c + 1) * half + 1 + length, len(piece))
        key = RollingHash(piece, _B1).of(*core) + c.astype(np.uint64)
        view, digests = memoryview(piece), []
        for start, stop, shift in zip(lo.tolist(), (hi + length).tolist(), (p - lo).tolist()):
            digests.append(hashlib.blake2b(view[start:stop], digest_size=16, salt=shift.to_bytes(8, "little")).digest())
        ctx = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        parts.append((key.view(np.int64), ctx[:, 0], ctx[:, 1], lo + at, hi + at))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def suffix_order(symbols: np.ndarray, breaks: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols; symbols are 1 to 256, 0 at ``breaks``, each of which differs from all others."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    wide = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.int64)
    alive = np.ones(n, bool)
    for k in range(7):
        now = wide[k : k + n]
        key = (key << 9) | np.where(alive, now, 0)
        alive &= now != 0
    order = np.lexsort((np.arange(n), key)) if n < 2 else np.argsort(key, kind="stable")
    sorted_key, short = key[order], ~alive[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | short[1:] | short[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = starts
    k = 7
    while k < depth:
        single = new & np.concatenate([new[1:], [True]])
        where = np.flatnonzero(~single)
        if not len(where):
            break
        own = order[where]
        second = rank[np.minimum(own + k, n)]
        head = starts[where]
        by = np.argsort(head * (n + 2) + second + 1, kind="stable")
        order[where] = own[by]
        second, head = second[by], head[by]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (second[1:] != second[:-1]) | (head[1:] != head[:-1])
        new[where] = fresh
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = starts
        k *= 2
    return order


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over ``texts`` laid end to end with a break after each: where each text begins, and two masks of
    places: those where a string of ``length`` starts that also starts elsewhere, and one place of each such string."""
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int16) + 1
    breaks = begins + lengths
    symbols[breaks] = 0
    n, m = len(symbols), len(texts)
    order = suffix_order(symbols, breaks, length)
    before = symbols[order - 1]  # the transform; the first suffix is preceded by the last break
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    following, preceding = np.full(n, n), np.full(n, -1)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    reached = np.zeros(n + 1, bool)  # boundaries whose common prefix is known, hence below ``length``
    reached[: m + 1] = True
    reached[n] = True
    counts = np.bincount(symbols, minlength=257)
    ends = np.cumsum(counts)
    present = np.flatnonzero(counts[1:]) + 1
    # Strings of one symbol: each break by itself, and each byte.
    left, right = (np.concatenate([np.arange(m) + k, ends[present - 1 + k]]) for k in (0, 1))
    reached[right] = True
    for _ in range(1, length):
        size = right - left
        total = int(size.sum())
        if not total:
            break
        at = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        inner = before[at] != 0
        first = at[inner & (preceding[at] < np.repeat(left, size))]
        last = at[inner & (following[at] >= np.repeat(right, size))]
        left, right = np.sort(step[first]), np.sort(step[last]) + 1
        fresh = ~reached[right]
        left, right = left[fresh], right[fresh]
        reached[right] = True
    equal = ~reached[:n]  # row i starts as row i - 1 does
    repeated, sample = np.zeros(n, bool), np.zeros(n, bool)
    hits = np.flatnonzero(equal)
    repeated[order[hits]] = repeated[order[hits - 1]] = True
    sample[order[hits[~equal[hits - 1]] - 1]] = True
    return begins, repeated, sample


def _context_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                rows = [(i, contexts_of(np.frombuffer((b["text"][i].as_py() or "").encode(), np.uint8), length)) for i in range(start, min(start + 256, b.num_rows))]
                index = pa.array(np.repeat([i for i, _ in rows], [len(r[0]) for _, r in rows]))
                columns = [pa.array(np.concatenate([r[k] for _, r in rows]), pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(index), b["h"].take(index), *columns], ["doc_id", "h", "key", "ctx", "ctx2", "lo", "hi"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, key long, ctx long, ctx2 long, lo long, hi long")


def _extract(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, ctx, ctx2, n (occurrences), blocks and the bytes of each distinct context, read from its first occurrence."""
    lists = wanted.groupBy(F.col("first.doc_id").alias("d"), F.col("first.h").alias("x")).agg(F.collect_list(F.struct("key", "ctx", "ctx2", "n", "blocks", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"))).alias("spots"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    held = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x"))).select("text", "spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ctx", "ctx2", "n", "blocks"]
        for b in batches:
            for i in range(b.num_rows):
                data, spots = b["text"][i].as_py().encode(), b["spots"][i].as_py()
                arrays = [pa.array([s[c] for s in spots], pa.int64()) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([data[s["lo"] : s["hi"] + length] for s in spots], pa.binary())], [*names, "bytes"])

    return held.mapInArrow(cut, "key long, ctx long, ctx2 long, n long, blocks long, bytes binary")


def _judge(contexts: DataFrame, length: int) -> DataFrame:
    """Per distinct context the windows that repeat (``ranges``: from, to) and, in keys of several blocks, hashes of windows still to be compared."""
    contexts = stored(contexts)
    size = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    tasks = max(contexts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = contexts.withColumn("block", F.pmod("ctx", F.col("blocks"))).repartition(int(tasks), "key", "block").sortWithinPartitions("key", "block")

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        begins, repeated, sample = repeated_starts([r[4] for r in rows], length)
        out = []
        for (key, ctx, ctx2, n, text, blocks), at in zip(rows, begins):
            windows = len(text) - length + 1
            hit, one = repeated[at : at + windows].copy(), sample[at : at + windows]
            todo = []
            if blocks > 1:
                # What is unique here, or stands for its repeats here, may occur in another block.
                places = np.flatnonzero(~hit | one)
                data = np.frombuffer(text, np.uint8)
                h1, h2 = (RollingHash(data, base).of(places, places + length).view(np.int64) for base in (_B1, _B2))
                todo = [{"h1": int(x), "h2": int(y), "w": int(w), "open": not (hit[w] or n > 1)} for x, y, w in zip(h1, h2, places)]
            if n > 1:
                hit[:] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            out.append((key, ctx, ctx2, [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])], todo))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("w", pa.int64()), ("open", pa.bool_())]))]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["key", "ctx", "ctx2", "ranges", "todo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for key, ctx, ctx2, n, blocks, text, block in zip(*(b[c].to_pylist() for c in ("key", "ctx", "ctx2", "n", "blocks", "bytes", "block"))):
                if size >= BLOCK_BYTES and (key, block) != last:
                    yield judge(held)
                    held, size = [], 0
                held.append((key, ctx, ctx2, n, text, blocks))
                size += len(text)
                last = key, block
        if held:
            yield judge(held)

    return dealt.mapInArrow(run, "key long, ctx long, ctx2 long, ranges array<struct<a:long,b:long>>, todo array<struct<h1:long,h2:long,w:long,open:boolean>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, h (hash of the text) and spans (byte from, to; unmerged) of the documents with repeats."""
    rows = stored(_context_rows(docs, length))
    hot = max(HOT_ROWS, int(rows.count() * HOT_SHARE))
    digest = F.struct("ctx", "ctx2")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("c0"), F.max(digest).alias("c1")).where(F.col("n") > 1)
    shared = stored(split_join(rows, stored(keys.select("key", "n", (F.col("c0") == F.col("c1")).alias("alike"))), ["key"], hot).drop("n"))
    differing = shared.where(~F.col("alike"))
    distinct = differing.groupBy("key", "ctx", "ctx2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "lo", "hi")).alias("first"))
    distinct = materialize(distinct)
    blocks = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("of")).select("key", "of", F.ceil(F.col("of") / F.lit(BLOCK_CONTEXTS)).alias("blocks"))
    wanted = split_join(distinct.withColumnRenamed("n", "times"), materialize(blocks.withColumnRenamed("of", "n")), ["key"], hot).drop("n").withColumnRenamed("times", "n")
    judged = stored(_judge(_extract(docs, wanted, length), length))
    todo = judged.select("key", "ctx", "ctx2", F.inline("todo"))
    twice = todo.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h1", "h2")
    across = todo.where("open").join(twice, ["h1", "h2"]).select("key", "ctx", "ctx2", F.col("w").alias("a"), (F.col("w") + 1).alias("b"))
    ranges = judged.select("key", "ctx", "ctx2", F.inline("ranges")).unionByName(across).groupBy("key", "ctx", "ctx2").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    ranges = stored(ranges.join(distinct.select("key", "ctx", "ctx2", "n"), ["key", "ctx", "ctx2"]))
    met = split_join(differing, ranges, ["key", "ctx", "ctx2"], hot).select("doc_id", "h", "lo", F.inline("ranges"))
    hits = met.select("doc_id", "h", (F.col("lo") + F.col("a")).alias("from"), (F.col("lo") + F.col("b") - 1 + length).alias("to"))
    whole = shared.where("alike").select("doc_id", "h", F.col("lo").alias("from"), (F.col("hi") + length).alias("to"))
    return whole.unionByName(hits).groupBy("doc_id", "h").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    spans = repeated_spans(docs, length).withColumnsRenamed({"doc_id": "d", "h": "x"})
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    both = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                data, at, kept, n = b["text"][i].as_py().encode(), 0, [], 0
                for start, end in sorted((s["from"], s["to"]) for s in b["spans"][i].as_py() or ()):
                    if start > at or not n:
                        kept.append(data[at:start])
                        n += 1
                    at = max(at, end)
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(remove, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
