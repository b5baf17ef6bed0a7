"""Language-model scores by logistic context mixing over the bits of words.

A text is its words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end.  The most
frequent tokens of the training documents and one symbol for all others get a Huffman
code, so a token is a walk of a few binary decisions.  Each decision is predicted by
three counters: of the code's node alone, of (previous symbol, node) and of (two
previous symbols, node), the latter two hashed into tables.  Their logits are mixed by
weights that a gate picks (how much the two hashed counters have seen); an adaptive
probability map then corrects the mixed probability.  Weights and map, a few hundred
numbers, are learned online over all training documents in every partition: after each
``STEP`` decisions the weights follow the error by rates that shrink with what each
weight has moved (a bit's own count is left out); partitions are averaged.
A token outside the code costs its symbol plus its share of the rare tokens' mass,
(c + 0.5) of the sum, with c its training count and 0 for unknown tokens.

Vocabulary, counters, weights and map cover all training documents.  Tables grow with
the square root of the training tokens N, 2**(7 + log2(N) / 2) slots and a quarter as
many coded words, up to ``MAX_TABLE_BITS`` and ``MAX_SYMBOLS``, which bound what driver
and tasks hold; they also hold the counts of about ``HELD_WORDS`` words.  Counts of all
rarer tokens stay distributed and are joined.

Edge cases: null and empty texts are one end; repeated rows are scored alike; very long
texts are worked on in pieces whose contexts run on; a null doc_id counts as empty text
in the split; without training documents N and V are 0 and every token is unknown; an
empty table gives an empty result; other columns are unread.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeprism.llm.common import stored

MAX_TABLE_BITS, MAX_SYMBOLS = 24, 1 << 20
#: Words whose counts tasks hold, about; counts of rarer ones are joined.
HELD_WORDS = 327_680
#: Folds by crc32 of the id as text, and the one that is held out.
FOLDS, HELD = 5, 1
#: The end of a text as a token; no word is empty.
END = b""
#: Count levels of a hashed counter that gates tell apart: 0, 1 to 3, 4 to 15, more.
LEVEL = np.searchsorted([1, 4, 16], np.arange(17), side="right").astype(np.int8)
GATES, STEPS, RATE, PRIOR = 16, 33, 0.05, 0.4
#: Decisions between two steps of the weights, and counters that travel together.
STEP, CHUNK = 8_192, 16_384
#: Steps of the mixed logit in one unit; a multiple of 4.
GRAIN = 64
#: Tokens that are worked on together, and distinct tokens that a task counts before it passes them on.
BATCH, DISTINCT = 60_000, 200_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def tokens_of(text: bytes) -> list[bytes]:
    """Words and end of a text in UTF-8.  bytes.lower() changes A-Z alone, bytes.split() cuts at space and 0x09 to 0x0D."""
    return [*text.lower().split(), END]


_LOG = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)


def _logs(counts: np.ndarray) -> np.ndarray:
    """log(counts + PRIOR), from a table where counts are small."""
    out = _LOG[np.minimum(counts, len(_LOG) - 1)]
    large = counts >= len(_LOG)
    if large.any():
        out[large] = np.log(counts[large] + PRIOR)
    return out


def _with_levels(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logits whose last two bits, which make no difference, hold the level of ``counts``, so that both are one lookup."""
    level = LEVEL[np.minimum(counts, len(LEVEL) - 1)]
    return ((logits.astype(np.float32).view(np.int32) & ~3) | level).view(np.float32)


class Code:
    """Huffman code of symbols 0 to n - 1 by weight: the nodes and bits from the root to each."""

    def __init__(self, weights: list[float]):
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(max(1, 2 * n - 1), np.int32), np.zeros(max(1, 2 * n - 1), np.int8)
        for node in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = node
            side[b[1]] = 1
            heapq.heappush(heap, (a[0] + b[0], node))
        depth = np.zeros(max(1, 2 * n - 1), np.int32)
        for node in range(2 * n - 3, -1, -1):  # a parent comes after its children
            depth[node] = depth[parent[node]] + 1
        self.size = depth[:n].copy()
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int32)
        self.nodes, self.bits = np.zeros(int(self.size.sum()), np.int32), np.zeros(int(self.size.sum()), np.int8)
        at, symbol, left = np.arange(n), np.arange(n), self.size.copy()
        while len(symbol := symbol[left[symbol] > 0]):  # one step up for all symbols that are not at the root
            left[symbol] -= 1
            place, node = self.start[symbol] + left[symbol], at[symbol]
            self.nodes[place], self.bits[place] = parent[node] - n, side[node]
            at[symbol] = parent[node]
        self.inner = max(1, n - 1)
        # Four levels of a walk share a group of 16 slots, which lie together in memory: by the node where they begin, and the bits since.
        level = np.arange(len(self.nodes)) - np.repeat(self.start, self.size)
        begin, self.leaf = np.arange(len(self.nodes)) - level % 4, np.ones(len(self.nodes), np.uint8)
        for back in range(3):
            rows = np.flatnonzero(level % 4 > back)
            self.leaf[rows] = 2 * self.leaf[rows] + self.bits[begin[rows] + back]
        self.mix = (self.nodes[begin].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)

    def counters(self, counts: np.ndarray) -> np.ndarray:
        """Occurrences of both bits of every node, from those of the symbols."""
        places = 2 * self.nodes.astype(np.int64) + self.bits
        return np.bincount(places, np.repeat(counts, self.size), 2 * self.inner).astype(np.int64).reshape(-1, 2)


class Words:
    """The most frequent words with their counts, as one string; each worker makes one dictionary of it."""

    def __init__(self, held: list[tuple[bytes, int]]):
        self.joined, self.counts = b"\n".join(w for w, _ in held), np.array([c for _, c in held] or [0], np.int64)
        self.size, self.place = len(held), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None}

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word by frequency, -1 for words that are not held."""
        if self.place is None:
            self.place = dict(zip(self.joined.split(b"\n"), range(self.size)))  # no word has a line end
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))


class Model:
    """What all tasks share: symbols, code, counters, weights and map."""

    def __init__(self, top: list[tuple[bytes, int]], rare_mass: float, table_bits: int = 18):
        self.counts = np.array([c for _, c in top], float)
        self.rare, self.first, self.bits = len(top), len(top) + 1, table_bits
        self.code = Code([*self.counts, max(rare_mass, 0.5)])
        self.base = np.log10(np.append(self.counts + 0.5, 1.0))
        self.slots = [len(self.code.size), 2 << table_bits, 2 << table_bits]  # of the first context symbols are counted; its nodes follow from them
        self.weights = np.tile(np.array([0.4, 0.3, 0.3, 0.0]), (GATES, 1))
        self.map, self.moved = np.zeros((STEPS, 2)), np.zeros((GATES, 4))

    def contexts(self, symbols: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols one and two places before each; firsts: where texts begin."""
        one = np.concatenate([[self.first], symbols[:-1]]).astype(np.uint64)
        one[firsts] = self.first
        two = np.concatenate([np.array([self.first], np.uint64), one[:-1]])
        two[firsts] = self.first
        return one, two

    def decisions(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Owner token, bit, place in the code and the slots in the two hashed tables of every decision."""
        size = self.code.size[symbols]
        owner = np.repeat(np.arange(len(symbols)), size)
        at = np.repeat(self.code.start[symbols] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        bit = self.code.bits.take(at)
        c1 = one * np.uint64(0x9E3779B97F4A7C15)
        c1 ^= c1 >> np.uint64(29)
        c2 = c1 * np.uint64(0xBF58476D1CE4E5B9) + two * np.uint64(0xC2B2AE3D27D4EB4F)
        c2 ^= c2 >> np.uint64(29)
        mix, leaf, slots = self.code.mix.take(at), self.code.leaf.take(at), [at]
        for c in (c1, c2):
            h = np.repeat((c >> np.uint64(32)).astype(np.uint32), size)
            h += mix
            h *= np.uint32(0x85EBCA6B)
            h >>= np.uint32(32 - self.bits)
            h ^= leaf
            slots.append(h.astype(np.int64))  # take() is slow with other types
        return owner, bit, slots

    def pieces(self, symbols: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, list[np.ndarray]]]]:
        """Decisions of a run, a bounded piece at a time; contexts run on where a long text is cut."""
        one, two = self.contexts(symbols, firsts)
        for at in range(0, len(symbols), BATCH):
            part = slice(at, min(len(symbols), at + BATCH))
            yield part, self.decisions(symbols[part], one[part], two[part])

    def ready(self) -> None:
        """For learning: logits of all counters with one occurrence of the bit left out, by place in the code or by slot and bit."""
        self.logits = []
        for t in self.tables:
            x = np.empty(t.shape, np.float32)
            x[:, 1] = _logs(np.maximum(t[:, 1] - 1, 0)) - _logs(t[:, 0])
            x[:, 0] = _logs(t[:, 1]) - _logs(np.maximum(t[:, 0] - 1, 0))
            self.logits.append(_with_levels(x, np.maximum(t.sum(axis=1, dtype=np.int64) - 1, 0)[:, None]).reshape(-1))
        self.logits[0] = self.logits[0][2 * self.code.nodes.astype(np.int64) + self.code.bits]

    def seal(self) -> None:
        """For scoring: logits of all counters, by place in the code or by slot, take the place of the counters."""
        self.logits = [_with_levels(_logs(t[:, 1]) - _logs(t[:, 0]), t.sum(axis=1, dtype=np.int64)) for t in self.tables]
        self.logits[0] = self.logits[0][self.code.nodes]
        self.tables = None

    def slim(self, *names: str) -> "Model":
        """A copy without the words and without attributes ``names``, to send to tasks."""
        import copy

        out = copy.copy(self)
        for name in ("words", "base", "counts", *names):
            out.__dict__.pop(name, None)
        return out

    def inputs(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Logits of every decision and the gate that they pick."""
        x = [t.take(s) for t, s in zip(self.logits, slots)]
        gate = x[1].view(np.int32) & 3
        gate <<= 2
        gate |= x[2].view(np.int32) & 3
        return x, gate.astype(np.int64)

    def steps(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """The mixed logit in steps of 1 / ``GRAIN`` from -12."""
        w = np.ascontiguousarray(self.weights.T, np.float32)
        w *= np.float32(GRAIN)
        w[3] += np.float32(12 * GRAIN)
        z = w[3].take(gate, mode="clip")
        for k in range(3):
            part = w[k].take(gate, mode="clip")
            part *= x[k]
            z += part
        return np.clip(z, 0, 24 * GRAIN, out=z).astype(np.int64)

    def table(self) -> np.ndarray:
        """log10 probability of bits 0 and 1 at each step of the mixed logit, as the map refines it."""
        z = np.linspace(-12, 12, 24 * GRAIN + 1)
        p, grid = 1 / (1 + np.exp(-z)), np.linspace(-12, 12, STEPS)
        refined = (self.map[:, 1] + 20 / (1 + np.exp(-grid))) / (self.map.sum(axis=1) + 20)
        p = (p + np.interp(z, grid, refined)) / 2
        return np.log10(np.stack([1 - p, p], axis=1)).reshape(-1)

    def log10(self, symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out, table = np.zeros(len(symbols)), self.table()
        for part, (owner, bit, slots) in self.pieces(symbols, firsts):
            step = self.steps(*self.inputs(slots))
            step <<= 1
            step += bit
            out[part] = np.bincount(owner, table.take(step), part.stop - part.start)
        return out

    def learn(self, symbols: np.ndarray, firsts: np.ndarray) -> None:
        """Online steps of weights and map over a run of training symbols."""
        sigmoid = (1 / (1 + np.exp(-np.linspace(-12, 12, 24 * GRAIN + 1)))).astype(np.float32)
        for _, (_, bit, slots) in self.pieces(symbols, firsts):
            for slot in slots[1:]:
                slot <<= 1
                slot += bit
            (x, gate), steps = self.inputs(slots), []
            for at in range(0, len(bit), STEP):
                part = slice(at, at + STEP)
                inputs, g, b = [v[part] for v in x], gate[part], bit[part]
                steps.append(self.steps(inputs, g))
                miss = b - sigmoid.take(steps[-1])
                seen = np.maximum(np.bincount(g, minlength=GATES), 1)
                pull = np.stack([np.bincount(g, v, GATES) / seen for v in (*(miss * v for v in inputs), miss)], axis=1)
                self.moved += pull * pull
                self.weights += RATE * pull / np.sqrt(self.moved + 1e-6)
            near = (np.concatenate(steps) + 3 * GRAIN // 8) // (3 * GRAIN // 4)
            self.map += np.bincount(near * 2 + bit, minlength=2 * STEPS).reshape(STEPS, 2)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes], np.ndarray]]:
    """Batch, first and last row, tokens and text starts for runs of rows of about ``BATCH`` tokens."""
    for b in batches:
        row, words, firsts = 0, [], []
        for i, text in enumerate(b["text"]):
            firsts.append(len(words))
            words += tokens_of(text.as_py())
            if len(words) >= BATCH or i + 1 == b.num_rows:
                yield b, row, i + 1, words, np.array(firsts, np.int64)
                row, words, firsts = i + 1, [], []


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and counts, of ``DISTINCT`` tokens or somewhat more at a time."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    seen: Counter = Counter()
    for _, _, _, words, _ in _runs(batches):
        seen.update(words)
        if len(seen) >= DISTINCT:
            yield batch()
            seen.clear()
    yield batch()


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, symbols and text starts for runs of coded rows of about ``BATCH`` symbols."""
    for b in batches:
        ends = np.asarray(b["ids"].offsets).astype(np.int64)
        ids, row = np.asarray(b["ids"].values), 0
        while row < b.num_rows:
            stop = min(b.num_rows, max(row + 1, int(np.searchsorted(ends, ends[row] + BATCH, side="right")) - 1))
            yield b.slice(row, stop - row), ids[ends[row] : ends[stop]], ends[row:stop] - ends[row]
            row = stop


def frequent(counts: DataFrame, most: int, least: int) -> list[tuple[bytes, int]]:
    """Words and counts by descending count, then word: at most ``most``, but the ``least`` most frequent always.

    Words reach the driver by a lower bound on their count, so that nothing is sorted;
    only where ties leave too few of them, ``least`` are sorted out.
    """
    step = F.floor(F.log2("c") * 8)
    sizes = {r["s"]: r["n"] for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # some 400 at most
    bound, size = max(sizes, default=0) + 1, 0
    for s in sorted(sizes, reverse=True):
        if size + sizes[s] > most:
            break
        bound, size = s, size + sizes[s]
    found = counts.where(step >= bound)
    if size < least and size < sum(sizes.values()):
        found = counts.orderBy(F.col("c").desc(), "word").limit(least)
    words = found.toArrow()
    return sorted(zip(words["word"].to_pylist(), words["c"].to_pylist()), key=lambda x: (-x[1], x[0]))


def sized(n: int) -> tuple[int, int]:
    """Coded symbols and bits of the hashed tables for n training tokens."""
    bits = min(MAX_TABLE_BITS, max(10, math.ceil(7 + math.log2(max(n, 1)) / 2)))
    return min(MAX_SYMBOLS, 1 << (bits - 2)), bits


def vocabulary(tokens: DataFrame, symbols: int | None = None, table_bits: int | None = None) -> tuple[Model, DataFrame, int, int]:
    """The model before learning, the training counts (word, c), and N and V; ``tokens`` has held and text (binary)."""
    known = tokens.where(~F.col("held")).select("text")
    counts = stored(known.mapInArrow(_tally, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"], total["v"]
    most, bits = sized(n)
    symbols, table_bits = symbols or most, table_bits or bits
    held = frequent(counts, max(symbols, HELD_WORDS), symbols)
    top = held[:symbols]
    model = Model(top, n - sum(c for _, c in top) + 0.5 * (v - len(top) + 1), table_bits)
    model.words = Words(held)
    return model, counts, n, v


def coded(tokens: DataFrame, model: Model, *names: str) -> DataFrame:
    """Columns ``names`` of ``tokens`` with rid, ids (symbols), n_tokens, known, many (rare tokens), heavy and held_logs
    (sums of log10 weights that tasks know) and rare (the other words, for a join)."""
    shared = tokens.sparkSession.sparkContext.broadcast((model.words, model.base, model.rare))  # code and tables are not needed here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, base, rare), rows, place = shared.value, 0, TaskContext.get().partitionId() << 33
        for b, row, stop, words, firsts in _runs(batches):
            found, size = known.places(words), stop - row
            ids = np.where((found < 0) | (found > rare), rare, found)
            bounds = np.append(firsts, len(ids))
            text = np.repeat(np.arange(size), np.diff(bounds))
            at = np.flatnonzero(ids == rare)
            held = np.where(found[at] < 0, 0, known.counts[found[at]])
            far = at[held == 0]
            sent = np.bincount(text[far], minlength=size)
            arrays = {
                "rid": pa.array(place + rows + np.arange(size)), **{c: b.slice(row, size)[c] for c in names},
                "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()), "known": pa.array(np.diff(bounds) - sent, pa.int64()),
                "many": pa.array(np.bincount(text[at], minlength=size), pa.int64()), "heavy": pa.array(np.bincount(text, base[ids], size), pa.float64()),
                "held_logs": pa.array(np.bincount(text[at], np.where(held > 0, np.log10(held + 0.5), 0), size).astype(float)),
                "rare": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sent)]), pa.int32()), pa.array([words[i] for i in far], pa.binary())),
            }
            rows += size
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    kinds = dict(tokens.dtypes)
    own = "".join(f"{c} {kinds[c]}, " for c in names)
    return tokens.mapInArrow(run, f"rid long, {own}ids array<int>, n_tokens long, known long, many long, heavy double, held_logs double, rare array<binary>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of counters that several tasks sent, added up: t, chunk, counts (little-endian long)."""
    seen: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for t, chunk, counts in zip(*(b[c].to_pylist() for c in ("t", "chunk", "counts"))):
            own = np.frombuffer(counts, "<i4").astype(np.int64)
            seen[t, chunk] = seen[t, chunk] + own if (t, chunk) in seen else own
    if seen:
        t, chunk = zip(*seen)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(chunk, pa.int32()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], ["t", "chunk", "counts"])


def fitted(model: Model, known: DataFrame) -> Model:
    """``model`` with counters, weights and map learned from all rows of ``known`` (ids)."""
    spark = known.sparkSession
    shared = spark.sparkContext.broadcast(model.slim())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = [np.zeros(size, np.int64) for size in m.slots]
        for _, ids, firsts in _coded(batches):
            sums[0] += np.bincount(ids, minlength=len(sums[0]))
            for _, (_, bit, slots) in m.pieces(ids, firsts):
                for total, place in zip(sums[1:], slots[1:]):
                    place <<= 1
                    place += bit
                    np.add.at(total, place, 1)
        for t, total in enumerate(sums):
            for chunk in range(0, len(total), CHUNK):
                part = total[chunk : chunk + CHUNK].astype("<i4")
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([chunk // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["t", "chunk", "counts"])

    # Each task sends its tables whole, so several partitions share one where that leaves no core idle.
    tasks = max(spark.sparkContext.defaultParallelism, known.rdd.getNumPartitions() // 4)
    sent = known.select("ids").coalesce(tasks).mapInArrow(count, "t int, chunk int, counts binary")
    found = stored(sent.repartition("t", "chunk").mapInArrow(_sums, "t int, chunk int, counts binary")).toArrow()  # the tables, whose size is bounded
    shared.destroy()  # what it served is stored
    sums = [np.zeros(model.slots[0], np.int64), *(np.zeros(size, np.int32) for size in model.slots[1:])]
    for b in found.to_batches():
        for t, chunk, counts in zip(b["t"].to_pylist(), b["chunk"].to_pylist(), b["counts"]):
            part = np.frombuffer(counts.as_buffer(), "<i8")
            sums[t][chunk * CHUNK : chunk * CHUNK + len(part)] = np.minimum(part, 2**31 - 1) if t else part
    del found
    model.tables = [model.code.counters(sums[0]), *(x.reshape(-1, 2) for x in sums[1:])]
    del sums
    model.ready()
    counted = spark.sparkContext.broadcast(model.slim("tables"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        m, seen = copy.copy(counted.value), 0
        m.weights, m.map, m.moved = m.weights.copy(), m.map.copy(), m.moved.copy()
        for _, ids, firsts in _coded(batches):
            seen += len(ids)
            m.learn(ids, firsts)
        if seen:
            values = np.concatenate([m.weights.ravel() * seen, m.map.ravel(), [seen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "x"])

    learned = {r["i"]: r["x"] for r in known.select("ids").mapInArrow(fit, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}  # a few hundred numbers
    counted.destroy()
    if learned:
        values = np.array([learned[i] for i in range(len(learned))])
        model.weights = (values[: 4 * GATES] / values[-1]).reshape(GATES, 4)
        model.map = values[4 * GATES : -1].reshape(STEPS, 2)
    model.seal()
    return model


def train(tokens: DataFrame, symbols: int | None = None, table_bits: int | None = None) -> tuple[Model, DataFrame, int, int]:
    """The model, the training counts (word, c), and N and V; ``tokens`` has held and text (binary)."""
    model, counts, n, v = vocabulary(tokens, symbols, table_bits)
    return fitted(model, stored(coded(tokens.where(~F.col("held")), model))), counts, n, v


def score(docs: DataFrame, symbols: int | None = None, table_bits: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    tokens = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    tokens = tokens.withColumn("bytes", F.octet_length("text").cast("long"))
    model, counts, n, v = vocabulary(tokens, symbols, table_bits)
    rows = stored(coded(tokens, model, "doc_id", "held", "bytes"))
    model = fitted(model, rows.where(~F.col("held")))
    mass = n - float(model.counts.sum()) + 0.5 * (v - len(model.counts) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model.slim())
    passed = ["rid", "doc_id", "held", "bytes", "n_tokens", "known", "many", "heavy", "held_logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, firsts in _coded(batches):
            logs = shared.value.log10(ids, firsts)
            total = np.add.reduceat(logs, firsts)  # every text has its end
            yield pa.RecordBatch.from_arrays([*(part[c] for c in passed), pa.array(total)], [*passed, "mixed"])

    kinds = dict(rows.dtypes)
    scored = rows.select(*passed, "ids").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in passed) + ", mixed double")
    words = rows.select("rid", F.explode("rare").alias("word"))
    c = F.coalesce("c", F.lit(0))
    rest = words.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.log10(c + 0.5)).alias("logs"), F.sum((c > 0).cast("long")).alias("found"))
    logs = F.col("held_logs") + F.coalesce("logs", F.lit(0.0))
    base = F.col("heavy") + logs - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    mixed = F.col("mixed") + logs - F.col("many") * float(np.log10(mass))
    return scored.join(rest, "rid", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), mixed.alias("score"), F.when(F.col("bytes") > 0, -mixed / float(np.log10(2)) / F.col("bytes")).alias("bits_per_byte"),
    )
