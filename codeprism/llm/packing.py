"""Packing of tokenized documents into sequences by cutting-stock column generation.

A document's ids are cut into whole sequences of ``size`` ids, a body of a multiple of
``unit`` ids and a tail of fewer than ``unit``.  The bodies' lengths form a histogram
of at most ``size / unit - 1`` entries, which is all the driver sees.  A linear program
over patterns (multisets of lengths that fill a sequence exactly) covers as much of it
as possible: the simplex method starts from no patterns and a knapsack dynamic program
prices new ones until none helps.  The solution is rounded down; documents are ranked
within their length, and each rank range belongs to one place of one pattern, so every
executor finds a document's sequence from a small table.  Bodies that the rounding or
a lack of partners leaves, and all tails, are laid end to end and cut at every ``size``
ids; the end of it goes into sequences of power-of-two length.  So no id of padding is
needed.

Ranks come from a window over (length, bucket of documents) plus offsets, so that a
length that a third of all documents share is not ranked by one task.

Edge cases: null and empty texts are one id (0); equal rows are packed each on their
own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprism.llm.bpe import WHITE, in_batches
from codeprism.llm.common import broadcast_if_small, materialize

SIZE, UNIT = 1024, 16
#: Cut bodies whose ids are read again: broadcast up to this number, joined by a shuffle beyond it.
BROADCAST_CUTS = 100_000
#: Chunks whose ids a worker keeps in each of two generations.
KEPT_CHUNKS = 250_000


class ChunkTokens:
    """Ids of whole texts as bytes (little-endian uint32), with a dictionary of chunks.

    A chunk is a run of white space with the run of other characters after it; the
    vocabulary's pattern never crosses from other characters to white space.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        from codeprism.llm.bpe import byte_symbols

        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.codec = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __missing(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = np.asarray(self.codec.encode_ordinary(chunk), "<u4").tobytes()
        self.ids[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.cut.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if len(self.ids) > KEPT_CHUNKS:
                self.old, self.ids = self.ids, {}
            get, missing = self.ids.get, self.__missing
            out += [get(c) or missing(c) for c in self.chunk.findall(part)]
        return b"".join(out)


@lru_cache(2)
def chunk_tokens(path: str) -> ChunkTokens:
    return ChunkTokens(path)


def fill_patterns(demand: dict[int, int], size: int) -> list[tuple[dict[int, int], float]]:
    """Patterns ({length: copies}, filling ``size`` exactly) and how often to use each.

    Maximizes the sequences that are filled without using more of a length than there
    is.  Column generation: with dual prices y of the lengths, the dynamic program
    finds the cheapest way to fill a sequence; if it costs less than 1, the pattern
    enters the basis; a negative price lets its length's slack enter.
    """
    lengths = sorted(r for r, n in demand.items() if n > 0)
    if not lengths:
        return []
    k, w = len(lengths), np.array(lengths)
    inverse, x, cost = np.eye(k), np.array([demand[r] for r in lengths], float), np.zeros(k)
    basis: list[dict[int, int] | None] = [None] * k
    for _ in range(200 * k):
        y = cost @ inverse
        worst = int(y.argmin())
        if y[worst] < -1e-9:
            column, value, pattern = np.eye(k)[worst], 0.0, None
        else:
            best, take = np.full(size + 1, np.inf), np.full(size + 1, -1)
            best[0] = 0
            for c in range(lengths[0], size + 1):
                n = bisect_right(lengths, c)
                costs = best[c - w[:n]] + y[:n]
                j = int(costs.argmin())
                best[c], take[c] = costs[j], j
            if best[size] >= 1 - 1e-7:
                break
            column, c = np.zeros(k), size
            while c:
                column[take[c]] += 1
                c -= lengths[take[c]]
            value, pattern = 1.0, {lengths[j]: int(n) for j, n in enumerate(column) if n}
        d = inverse @ column
        ratios = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratios.argmin())
        theta = ratios[out]
        x -= theta * d
        x[out] = theta
        np.maximum(x, 0, out=x)
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        cost[out], basis[out] = value, pattern
    return [(p, float(v)) for p, v in zip(basis, x) if p and v > 0]


class Layout:
    """Where the body and tail of a document of rest r (ids after its whole sequences) and rank k go.

    ``demand``: documents by rest.  The object is small enough for every task.
    """

    def __init__(self, demand: dict[int, int], size: int = SIZE, unit: int = UNIT):
        self.size, self.unit = size, unit
        bodies: dict[int, int] = {}
        tails: dict[int, int] = {}
        #: Rank of a rest's first document among the bodies and among the tails of its length.
        self.first: dict[int, tuple[int, int]] = {}
        for r in sorted(demand):
            body, tail = r // unit, r % unit
            self.first[r] = bodies.get(body, 0), tails.get(tail, 0)
            bodies[body], tails[tail] = bodies.get(body, 0) + demand[r], tails.get(tail, 0) + demand[r]
        bodies.pop(0, None), tails.pop(0, None)
        used = dict.fromkeys(bodies, 0)
        self.places: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in bodies}
        sequence = 0
        for pattern, times in fill_patterns(bodies, size // unit):
            times = min([int(times + 1e-6), *((bodies[b] - used[b]) // n for b, n in pattern.items())])
            if times <= 0:
                continue
            offset = 0
            for b, n in sorted(pattern.items()):
                self.places[b].append((used[b], n, sequence, offset))
                used[b] += n * times
                offset += n * b * unit
            sequence += times
        self.used, self.first_left, at = used, sequence, 0
        self.body_at, self.tail_at = {}, {}
        for b in sorted(bodies):
            self.body_at[b] = at
            at += b * unit * (bodies[b] - used[b])
        for t in sorted(tails):
            self.tail_at[t] = at
            at += t * tails[t]
        #: Edges of the sequences that the stream is cut into: whole ones, then powers of two.
        self.whole = at // size
        self.edges = [self.whole * size]
        for bit in range(size.bit_length() - 1, -1, -1):
            if (at - self.whole * size) >> bit & 1:
                self.edges.append(self.edges[-1] + (1 << bit))
        self.sequences = sequence + self.whole + len(self.edges) - 1

    def stream(self, begin: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of ids ``begin`` to ``begin + length`` of the stream."""
        at, end = begin, begin + length
        while at < end:
            if at < self.edges[0]:
                k, offset = divmod(at, self.size)
                stop = at - offset + self.size
            else:
                i = bisect_right(self.edges, at) - 1
                k, offset, stop = self.whole + i, at - self.edges[i], self.edges[i + 1]
            stop = min(stop, end)
            yield at - begin, stop - at, self.first_left + k, offset
            at = stop

    def body(self, r: int, rank: int) -> list[tuple[int, int, int, int]]:
        b, rank = r // self.unit, rank + self.first[r][0]
        if not b:
            return []
        if rank < self.used[b]:
            spans = self.places[b]
            start, n, sequence, offset = spans[bisect_right(spans, (rank, 1 << 60)) - 1]
            turn, slot = divmod(rank - start, n)
            return [(0, b * self.unit, sequence + turn, offset + slot * b * self.unit)]
        return list(self.stream(self.body_at[b] + (rank - self.used[b]) * b * self.unit, b * self.unit))

    def tail(self, r: int, rank: int) -> list[tuple[int, int, int, int]]:
        t = r % self.unit
        return list(self.stream(self.tail_at[t] + (rank + self.first[r][1]) * t, t)) if t else []


def token_table(docs: DataFrame, tokenizer: str, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """doc_id, h (hash of the text), doc_tokens, the CRC-32 of each whole sequence and of the body, and the tail's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_tokens(tokenizer)
        for b in batches:
            tokens, sums, tails = [], [], []
            for texts in in_batches(x.as_py() for x in b["text"]):
                for t in texts:
                    ids = coder.encode(t) + bytes(4)
                    n = len(ids) // 4
                    tail = 4 * (n - n % size % unit)
                    tokens.append(n)
                    sums.append([zlib.crc32(ids[i : min(i + 4 * size, tail)]) for i in range(0, tail, 4 * size)])
                    tails.append(ids[tail:])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["doc_id", "h", "doc_tokens", "sums", "tail"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, doc_tokens long, sums array<long>, tail binary")


def _ranked(tokens: DataFrame, size: int) -> tuple[DataFrame, dict[int, int], int]:
    """``tokens`` with rest, rank and whole_at; the histogram of the rests; the number of whole sequences."""
    rows = tokens.count()
    buckets = max(16, min(8192, rows // 200_000))
    keyed = tokens.select("*", (F.col("doc_tokens") % size).cast("int").alias("rest"), F.expr(f"doc_tokens div {size}").alias("whole"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).alias("bucket"))
    groups = keyed.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("w"))
    sums = groups.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).orderBy("rest").collect()  # at most ``size`` rows
    before, starts = 0, []
    for s in sums:
        starts.append((s["rest"], before))
        before += s["w"]
    earlier = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in starts for v in kv]), F.col("rest")), F.lit(0)) if starts else F.lit(0)
    offsets = groups.select("rest", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), (F.coalesce(F.sum("w").over(earlier), F.lit(0)) + base).alias("w0"))
    own = Window.partitionBy("rest", "bucket").orderBy("doc_id", "h")
    ranked = keyed.select("*", (F.row_number().over(own) - 1).alias("k"), F.coalesce(F.sum("whole").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("wk"))
    out = ranked.join(offsets, ["rest", "bucket"]).select("doc_id", "h", "doc_tokens", "sums", "tail", "rest", (F.col("k") + F.col("n0")).alias("rank"), (F.col("wk") + F.col("w0")).alias("whole_at"))
    return out, {s["rest"]: s["n"] for s in sums if s["rest"]}, before


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    kind = dict(docs.dtypes)["doc_id"]
    tokens = materialize(token_table(docs, tokenizer, size, unit))
    ranked, demand, wholes = _ranked(tokens, size)
    layout = Layout(demand, size, unit)
    names = ["doc_id", "h", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, h, n, sums, tail, rest, rank, at in zip(*(b[c].to_pylist() for c in ("doc_id", "h", "doc_tokens", "sums", "tail", "rest", "rank", "whole_at"))):
                for i in range(n // size):
                    out.append((doc, h, i * size, size, sums[i], n, layout.sequences + at + i, 0))
                for start, length, sequence, offset in layout.body(rest, rank) if rest else ():
                    out.append((doc, h, n - rest + start, length, sums[-1] if length == rest - rest % unit else None, n, sequence, offset))
                for start, length, sequence, offset in layout.tail(rest, rank) if rest else ():
                    out.append((doc, h, n - rest % unit + start, length, zlib.crc32(tail[4 * start : 4 * (start + length)]), n, sequence, offset))
            arrays = [pa.array(x, b.schema.field("doc_id").type if i == 0 else pa.int64()) for i, x in enumerate(zip(*out) if out else [()] * 8)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    pieces = materialize(ranked.mapInArrow(place, f"doc_id {kind}, h long, start long, length long, crc long, doc_tokens long, sequence_id long, offset long"))
    # Only bodies of the stream that an edge cuts lack a sum: at most two for each of its sequences.
    cut = pieces.where(F.col("crc").isNull()).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))
    cut = broadcast_if_small(cut, BROADCAST_CUTS)
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"), "text")
    wanted = texts.join(cut, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("h"))).select("doc_id", "h", "text", "cuts").dropDuplicates(["doc_id", "h"])

    def sum_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_tokens(tokenizer)
        for b in batches:
            out = []
            for doc, h, text, cuts in zip(*(b[c].to_pylist() for c in ("doc_id", "h", "text", "cuts"))):
                ids = coder.encode(text or "") + bytes(4)
                out += [(doc, h, c["start"], c["length"], zlib.crc32(ids[4 * c["start"] : 4 * (c["start"] + c["length"])])) for c in cuts]
            arrays = [pa.array(x, b.schema.field("doc_id").type if i == 0 else pa.int64()) for i, x in enumerate(zip(*out) if out else [()] * 5)]
            yield pa.RecordBatch.from_arrays(arrays, ["d", "x", "s", "l", "found"])

    sums = wanted.mapInArrow(sum_cuts, f"d {kind}, x long, s long, l long, found long")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")) & (F.col("start") == F.col("s")) & (F.col("length") == F.col("l"))
    known, lacking = pieces.where(F.col("crc").isNotNull()), pieces.where(F.col("crc").isNull())
    out = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return known.withColumnRenamed("crc", "ids_crc32").select(*out).unionByName(lacking.join(sums, same).withColumnRenamed("found", "ids_crc32").select(*out))
