"""Ranked lexical search over an index of two levels: byte impacts, then exact integers.

``build`` cuts documents into shards and writes, for each term of a shard, the documents
that hold it with two levels of facts: an impact byte, the saturated frequency scaled to
0..255 and rounded up, and the exact frequency.  ``search`` reads only the postings of the
terms asked for and deals them by shard.  In a shard the bytes give each document an upper
bound and (one step down) a lower bound of its score; every document whose upper bound
reaches the k-th highest lower bound is scored again from the exact integers.  A shard's
k-th lower bound is at most the corpus', so no document of the result is missed.  Each
shard hands on its best k; the best k of all follow by rank.

A frequent term is spread over all shards and a shard holds at most ``SHARD_DOCS``
documents, so no term, copy or query gathers the corpus in one task.  Queries are taken
in blocks of about ``QUERY_TERMS`` terms, which are sent to the tasks.

Edge cases: null and empty texts hold no term, are counted nowhere and never found; items
without a known term get no rows; very long texts and items count whole, a very long text
ends its shard; equal scores rank by doc_id, null ids last; repeated documents are ranked
each, repeated items answered each; an empty table of either kind gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeprism.llm.common import stored

#: Results of an item.
TOP = 10
#: Documents and tokens of a shard at most (a longer text has a shard to itself), and terms of queries sent to the tasks at once.
SHARD_DOCS, SHARD_TOKENS, QUERY_TERMS = 8192, 2_000_000, 200_000
#: Fixed values of the score: scale of a frequency, its saturation, weight of length in percent.
SCALE, SATURATION, LENGTH_PERCENT = 1_000_000_000, (1000, 8), 75
#: A saturated frequency is below this.
LIMIT = SCALE // SATURATION[0]
#: What an impact byte stands for: at most, and at least.
UPPER = np.array([b * LIMIT // 255 for b in range(256)], np.int64)
LOWER = np.array([0, *((b - 1) * LIMIT // 255 + 1 for b in range(1, 256))], np.int64)
#: Room for rounding in sums of bounds.
MARGIN = 1 + 1e-9
#: Bytes of UTF-8 to bytes of terms: A-Z in lower case, other ASCII but letters and digits to blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b < 91 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return (text or b"").translate(TERM_BYTES).split()


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (SATURATION[0] * tf + SATURATION[1] * m)


def length_factor(n: int, documents: int, terms: int) -> int:
    return 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // terms


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Index:
    """Postings by shard and term, the number of documents with a term, and of all their terms."""

    postings: DataFrame
    documents: int
    terms: int


def _counted(docs: DataFrame) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(terms_of(t.as_py())) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["documents", "terms"])

    sums = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary for each run of ``values`` that begins at ``starts``."""
    offsets = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


POSTINGS = ("shard", "term", "n", "docs", "impacts", "counts", "ids", "lengths")


def _shard(number: int, ids: pa.Array, texts: list[list[bytes]], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """Posting rows of one shard, and a row without term that has its documents' ids and length factors."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts])
    tokens = np.fromiter((known[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    pairs, tf = np.unique(tokens * SHARD_DOCS + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
    m = np.array([length_factor(int(n), documents, terms) for n in sizes], np.int64)
    doc, term = pairs % SHARD_DOCS, pairs // SHARD_DOCS
    impact = -(-saturated(tf, m[doc]) * 255 // LIMIT)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    size = len(starts)
    columns = [pa.array(np.full(size, number)), pa.array(list(known), pa.binary()), pa.array(np.diff(np.append(starts, len(term)))), _binaries(doc.astype(np.uint16), starts), _binaries(impact.astype(np.uint8), starts), _binaries(tf.astype(np.uint32), starts)]
    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(size, pa.list_(ids.type)), pa.nulls(size, pa.binary())], list(POSTINGS))
    head = [pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(texts)], pa.int64()), *[pa.nulls(1, pa.binary())] * 3]
    yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.tobytes()], pa.binary())], list(POSTINGS))


def build(docs: DataFrame) -> Index:
    """The index of all rows of ``docs`` (doc_id, text), as a table in the shared folder."""
    documents, terms = _counted(docs)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        ids, texts, held = [], [], 0

        def close():
            if texts:
                yield from _shard(next(numbers), pa.concat_arrays(ids), texts, documents, terms)

        for b in batches:
            for i in range(b.num_rows):
                found = terms_of(b["text"][i].as_py())
                if not found:
                    continue
                if len(texts) == SHARD_DOCS or held and held + len(found) > SHARD_TOKENS:
                    yield from close()
                    ids, texts, held = [], [], 0
                ids.append(b["doc_id"].slice(i, 1))
                texts.append(found)
                held += len(found)
        yield from close()

    schema = f"shard long, term binary, n long, docs binary, impacts binary, counts binary, ids array<{kind}>, lengths binary"
    return Index(stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)), documents, terms)


def asked(items: DataFrame) -> DataFrame:
    """number, item_id, term and times of every distinct term of every item; items that repeat have numbers of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        for b in batches:
            for i in range(b.num_rows):
                found, number = Counter(terms_of(b["text"][i].as_py())), next(numbers)
                item = pa.concat_arrays([b["item_id"].slice(i, 1)] * len(found)) if found else b["item_id"].slice(0, 0)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), item, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["number", "item_id", "term", "times"])

    return items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"number long, item_id {dict(items.dtypes)['item_id']}, term binary, times long")


class Shard:
    """The postings of a shard's asked terms, and its documents."""

    def __init__(self, rows: pa.Table):
        head = pc.index(pc.is_valid(rows["lengths"]), True).as_py()
        self.ids, self.m = rows["ids"][head].values, np.frombuffer(rows["lengths"][head].as_py(), np.int64)
        self.order = np.empty(len(self.m), np.int64)  # rank by doc_id, null last
        self.order[np.asarray(pc.sort_indices(self.ids, null_placement="at_end"))] = np.arange(len(self.m))
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, docs, impacts, counts in zip(*(rows[c].to_pylist() for c in ("k", "docs", "impacts", "counts"))):
            if k is not None:
                self.rows[k] = np.frombuffer(docs, np.uint16).astype(np.int64), np.frombuffer(impacts, np.uint8), np.frombuffer(counts, np.uint32).astype(np.int64)

    def best(self, terms: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``top`` best for an item of (term, weight times repeats)."""
        here = [(*self.rows[k], w) for k, w in terms if k in self.rows and w > 0]
        if not here:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs = np.concatenate([d for d, *_ in here])
        bound = lambda table: np.bincount(docs, np.concatenate([table[i] * float(w) for _, i, _, w in here]), len(self.m))
        upper, lower = bound(UPPER), bound(LOWER)
        least = np.partition(lower, -top)[-top] if len(lower) > top else 0.0
        near = np.flatnonzero((upper * MARGIN >= least) & (upper > 0))
        place, score = np.full(len(self.m), -1), np.zeros(len(near), np.int64)
        place[near] = np.arange(len(near))
        for d, _, tf, w in here:
            at = place[d]
            d, tf, at = d[at >= 0], tf[at >= 0], at[at >= 0]
            score[at] += w * saturated(tf, self.m[d])
        first = np.lexsort((self.order[near], -score))[:top]
        first = first[score[first] > 0]
        return near[first], score[first]


def _block(index: Index, block: DataFrame, top: int) -> DataFrame:
    """number, doc_id and score of each shard's best documents for a block of items."""
    spark = block.sparkSession
    rows = block.select("number", "term", "times").collect()
    number_of = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    names = F.broadcast(spark.createDataFrame([(t, k) for t, k in number_of.items()], "term binary, k int"))
    met = index.postings.where("term IS NOT NULL").join(names, "term")
    df = {r["k"]: r["df"] for r in met.groupBy("k").agg(F.sum("n").alias("df")).collect()}
    items: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in rows:
        if (k := number_of[bytes(r["term"])]) in df:
            items[r["number"]].append((k, weight(df[k], index.documents) * r["times"]))
    sent = spark.sparkContext.broadcast(dict(items))
    kind = dict(index.postings.dtypes)["ids"][6:-1]

    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows)
        numbers, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, terms in sent.value.items():
            d, s = shard.best(terms, top)
            numbers += [number] * len(d)
            docs.append(d)
            scores.append(s)
        return pa.Table.from_arrays([pa.array(numbers, pa.int64()), shard.ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["number", "doc_id", "score"])

    columns = ["shard", "k", "docs", "impacts", "counts", "ids", "lengths"]
    heads = index.postings.where("term IS NULL").withColumn("k", F.lit(None).cast("int"))
    return met.select(*columns).unionByName(heads.select(*columns)).groupBy("shard").applyInArrow(run, f"number long, doc_id {kind}, score long")


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of each item (item_id, text)."""
    wanted = stored(asked(items))
    blocks = max(1, -(-wanted.count() // QUERY_TERMS))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    best = None
    for b in range(blocks):
        part = _block(index, dealt.where(F.col("block") == b), top)
        best = part if best is None else best.unionByName(part)
    by_rank = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return first.join(wanted.select("number", "item_id").distinct(), "number").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``search`` of ``items`` in an index of ``docs``."""
    return search(build(docs), items, top)
