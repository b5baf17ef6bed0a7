"""Vector code compression: product codes by Lloyd rounds with heaps of slack.

Components become integers floor(1024 * x); vectors are cut into equal consecutive parts,
each coded by the index of its codebook's nearest entry.  A codebook starts as that part
of the vectors of the smallest ids; each round assigns all parts to their nearest entry
(squared distance, ties to the lower index) and moves entries to the floor of their
parts' mean.

A round need not look at every part again.  Vectors are kept in blocks; for each part of a
block every entry has a heap of the parts assigned to it, keyed by slack: the distance to
the second nearest entry less that to the entry itself, plus the entry's cumulative drift
at that time.  Drift grows each round by how far the entry moved and how far any other
entry moved at most, so a part whose key is above its entry's drift cannot have changed
its entry.  Only parts that drift has overtaken are popped, measured against all entries
and pushed onto the heap of the nearest.  All distances that decide are exact integers;
bounds are rounded so that a tie is measured again.

The state of a round (blocks with their heaps, and each task's sums by entry) is a table in
the shared folder; the one before it is deleted then.  The driver holds codebooks and at most
``FAN_IN`` arrays of sums, whose size follows from parts, entries and dimensions alone.

Edge cases: null vectors and vectors with null or non-finite components are dropped;
fewer kept vectors than entries make a smaller codebook; null ids come last, equal ids in
order of their components; repeated rows are coded alike and each counts; entries that no
part uses stay; labels may be null, and null labels are equal; an empty table gives an empty
result; vectors of different lengths, of a length that parts do not divide, or with
components too large for exact 64-bit distances raise ValueError; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import discard, split_join, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block at most, and arrays of sums that the driver adds up at most.
BLOCK, FAN_IN = 8192, 64
#: Relative and absolute margin of the bounds, above what rounding adds to them.
ROUNDING, MARGIN = 1e-12, 1e-6
#: Labels that hold at least one row in so many are joined by broadcast.
HOT_SHARE = 2000


def kept_rows(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(finite, F.lit(False)))


def components(vectors: np.ndarray) -> np.ndarray:
    """Integer components; as large as squared distances over a part stay within 64 bits."""
    out = np.floor(SCALE * vectors)
    peak = np.abs(out).max(initial=0.0)
    if peak * peak * 4 * max(1, out.shape[1]) >= 2**62:
        raise ValueError(f"components of {peak / SCALE:g} are too large for exact distances")
    return out.astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``entries``, as float64 where that holds them, else int64."""
    peak = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if int(peak) ** 2 * 4 * max(1, x.shape[1]) < 2**53:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its slack: how much farther the second nearest is at least."""
    d = distances(x, entries)
    best = d.argmin(axis=1)
    own = np.take_along_axis(d, best[:, None], 1)[:, 0]
    if d.shape[1] == 1:
        return best, np.full(len(x), np.inf)
    d = d.astype(np.float64)
    np.put_along_axis(d, best[:, None], np.inf, 1)
    return best, np.sqrt(d.min(axis=1)) * (1 - ROUNDING) - np.sqrt(own.astype(np.float64)) * (1 + ROUNDING)


class Heaps:
    """For one part of a block, a heap of (key, row) for each entry."""

    def __init__(self, sizes: np.ndarray, rows: np.ndarray, keys: np.ndarray):
        pairs, ends = list(zip(keys.tolist(), rows.tolist())), np.cumsum(sizes).tolist()
        self.heaps = [pairs[a:b] for a, b in zip([0, *ends], ends)]

    @classmethod
    def of(cls, entry: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, entry))  # what is sorted is a heap
        return cls(np.bincount(entry, minlength=entries), order, keys[order])

    def overtaken(self, drift: np.ndarray) -> list[int]:
        """Pop the rows whose key the drift of their entry has reached."""
        out = []
        for heap, limit in zip(self.heaps, (drift * (1 + ROUNDING) + MARGIN).tolist()):
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return out

    def push(self, rows: list[int], entry: np.ndarray, keys: np.ndarray) -> None:
        for r, e, k in zip(rows, entry.tolist(), keys.tolist()):
            heapq.heappush(self.heaps[e], (k, r))

    def dump(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = [p for h in self.heaps for p in h]
        return np.array([len(h) for h in self.heaps], np.uint32), np.array([r for _, r in pairs], np.uint32), np.array([k for k, _ in pairs], np.float64)


class Codebooks:
    """Entries (part, entry, component) and their cumulative drift (part, entry)."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.drift = entries, np.zeros(entries.shape[:2])

    def moved(self, counts: np.ndarray, sums: np.ndarray) -> Codebooks:
        """Entries at the floor of their parts' mean; drift grows by their own way and the longest way of another."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        way = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + ROUNDING)
        out = Codebooks(new)
        order = np.sort(way, axis=1)
        first, second = order[:, -1:], order[:, -2:-1] if way.shape[1] > 1 else order[:, -1:]
        out.drift = self.drift + way + np.where(way == first, np.where((way == first).sum(axis=1, keepdims=True) > 1, first, second), first)
        return out

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Block:
    """Vectors x (rows, components) with the heaps of each part."""

    def __init__(self, x: np.ndarray, heaps: list[Heaps] | None = None):
        self.x, self.heaps = x, heaps

    def part(self, p: int) -> np.ndarray:
        width = self.x.shape[1] // PARTS
        return self.x[:, p * width : (p + 1) * width]

    def settle(self, books: Codebooks) -> int:
        """Bring all heaps up to date; returns how many parts were measured against all entries."""
        count = 0
        if self.heaps is None:
            self.heaps = []
            for p in range(PARTS):
                entry, slack = nearest(self.part(p), books.entries[p])
                self.heaps.append(Heaps.of(entry, slack + books.drift[p][entry], books.entries.shape[1]))
            return PARTS * len(self.x)
        for p, heaps in enumerate(self.heaps):
            rows = heaps.overtaken(books.drift[p])
            if rows:
                entry, slack = nearest(self.part(p)[rows], books.entries[p])
                heaps.push(rows, entry, slack + books.drift[p][entry])
                count += len(rows)
        return count

    def codes(self) -> np.ndarray:
        """Entries by row and part."""
        out = np.zeros((len(self.x), PARTS), np.int64)
        for p, heaps in enumerate(self.heaps):
            sizes, rows, _ = heaps.dump()
            out[rows, p] = np.repeat(np.arange(len(sizes)), sizes)
        return out

    def sums(self, entries: int) -> np.ndarray:
        """For each part and entry the number of its parts and their sum."""
        out = np.zeros((PARTS, entries, 1 + self.x.shape[1] // PARTS), np.int64)
        for p, code in enumerate(self.codes().T):
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            used = code[order][starts]
            out[p, used, 0] = np.diff(np.append(starts, len(code)))
            out[p, used, 1:] = np.add.reduceat(self.part(p)[order], starts, axis=0)
        return out


STATE = ("vec_id", "label", "x", "sizes", "rows", "keys", "sums")


def _schema(kinds: dict[str, str]) -> str:
    return f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, x binary, sizes binary, rows binary, keys binary, sums binary"


def _lists(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _row(block: Block, ids: pa.Array, labels: pa.Array) -> pa.RecordBatch:
    parts = [np.concatenate(x).tobytes() for x in zip(*(h.dump() for h in block.heaps))]
    small = np.int16 if np.abs(block.x).max(initial=0) < 2**15 else np.int64
    x = small().dtype.char.encode() + block.x.astype(small).tobytes()
    return pa.RecordBatch.from_arrays([_lists(ids), _lists(labels), *(pa.array([v], pa.binary()) for v in (x, *parts, None))], list(STATE))


def _total(sums: np.ndarray, ids: pa.DataType, labels: pa.DataType) -> pa.RecordBatch:
    none = [pa.nulls(1, pa.list_(ids)), pa.nulls(1, pa.list_(labels)), *[pa.nulls(1, pa.binary())] * 4]
    return pa.RecordBatch.from_arrays([*none, pa.array([sums.tobytes()], pa.binary())], list(STATE))


def _blocks(batch: pa.RecordBatch, width: int, entries: int) -> Iterator[tuple[Block, pa.Array, pa.Array]]:
    """The blocks of a batch of state rows."""
    for i in range(batch.num_rows):
        raw, sizes, rows, keys = (batch[c][i].as_py() for c in ("x", "sizes", "rows", "keys"))
        x = np.frombuffer(raw, np.dtype(raw[:1].decode()), offset=1).astype(np.int64).reshape(-1, width)
        sizes = np.frombuffer(sizes, np.uint32).reshape(PARTS, entries)
        rows, keys = (np.frombuffer(v, t).reshape(PARTS, len(x)) for v, t in ((rows, np.uint32), (keys, np.float64)))
        yield Block(x, [Heaps(*v) for v in zip(sizes, rows, keys)]), batch["vec_id"][i].values, batch["label"][i].values


def first_round(kept: DataFrame, books: Codebooks) -> DataFrame:
    """State after all parts were measured once: blocks of up to ``BLOCK`` rows, and sums."""
    width, entries = books.entries.shape[0] * books.entries.shape[2], books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros((PARTS, entries, 1 + width // PARTS), np.int64), None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                if set(b["embedding"].value_lengths().to_pylist()) != {width}:
                    raise ValueError(f"vectors must all have {width} components")
                block = Block(components(np.asarray(b["embedding"].flatten()).reshape(-1, width)))
                block.settle(books)
                total += block.sums(entries)
                kinds = b["vec_id"].type, b["label"].type
                yield _row(block, b["vec_id"], b["label"])
        if kinds:
            yield _total(total, *kinds)

    return kept.mapInArrow(run, _schema(dict(kept.dtypes)))


def next_round(state: DataFrame, books: Codebooks) -> DataFrame:
    """State after the parts that drift has overtaken were measured again."""
    width, entries = books.entries.shape[0] * books.entries.shape[2], books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros((PARTS, entries, 1 + width // PARTS), np.int64), None
        for b in batches:
            for block, ids, labels in _blocks(b, width, entries):
                block.settle(books)
                total += block.sums(entries)
                kinds = ids.type, labels.type
                yield _row(block, ids, labels)
        if kinds:
            yield _total(total, *kinds)

    return state.where("sums IS NULL").mapInArrow(run, state.schema)


def coded(state: DataFrame, books: Codebooks, kinds: dict[str, str]) -> DataFrame:
    """vec_id, label, code and error of every vector under the final codebooks."""
    width, entries = books.entries.shape[0] * books.entries.shape[2], books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, labels in _blocks(b, width, entries):
                block.settle(books)
                codes = block.codes()
                error = sum(((block.part(p) - books.entries[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
                text = ["".join(f"{e:02x}" for e in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return state.where("sums IS NULL").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def summed(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by part and entry over all tasks of a round."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(v, np.int64) for b in batches for v in b["sums"].to_pylist()), np.zeros(int(np.prod(shape)), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = state.where("sums IS NOT NULL").select("sums").coalesce(FAN_IN).mapInArrow(add, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"], np.int64) for r in parts), np.zeros(int(np.prod(shape)), np.int64)).reshape(shape)
    return total[:, :, 0], total[:, :, 1:]


def first_books(kept: DataFrame, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks of the vectors of the ``entries`` smallest ids (none if there is no vector)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not rows:
        return None
    if len({len(r["embedding"]) for r in rows}) > 1 or len(rows[0]["embedding"]) % PARTS:
        raise ValueError(f"vectors must have equal lengths that {PARTS} divides")
    x = components(np.array([r["embedding"] for r in rows], np.float64))
    return Codebooks(x.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy())


def compress(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row whose vector is whole and finite."""
    kept = kept_rows(rows)
    kinds = dict(kept.dtypes)
    books = first_books(kept, entries)
    if books is None:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    shape = (*books.entries.shape[:2], 1 + books.entries.shape[2])
    state = stored(first_round(kept, books))
    for k in range(rounds):
        books = books.moved(*summed(state, shape))
        if k + 1 < rounds:
            before, state = state, stored(next_round(state, books))
            discard(before)
    out = stored(coded(state, books, kinds))
    discard(state)
    out = out.withColumn("l", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = out.groupBy("l").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    whole = split_join(out, sums, ["l"], max(1, out.count() // HOT_SHARE))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
