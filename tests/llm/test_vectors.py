"""Vector codes against plain Lloyd rounds."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeprism.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, l string, n long, code string"


def lloyd(rows, entries, rounds):
    """(vec_id, code, error, label_error, sha) of plain rounds in integers."""
    kept = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64), y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), 4, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1].tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    near = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(4):
            code = near(p).argmin(axis=1)
            for e in set(code):
                books[p, e] = x[code == e, p].sum(axis=0) // (code == e).sum()
    codes, errors = np.array([near(p).argmin(axis=1) for p in range(4)]).T, sum(near(p).min(axis=1) for p in range(4))
    label = {y: sum(int(e) for (_, _, z), e in zip(kept, errors) if z == y) for _, _, y in kept}
    sha = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in k), int(e), label[y], sha) for (i, _, y), k, e in zip(kept, codes, errors)), key=repr)


def found(df, **k):
    return sorted((tuple(r) for r in vc.compress(df, **k).collect()), key=repr)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == lloyd([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()], 256, 4)


@pytest.mark.parametrize("entries,rounds,block", [(1, 3, 50), (7, 0, 50), (7, 9, 13), (40, 12, 8192)])
def test_ties_nulls_and_repeats(spark, monkeypatch, entries, rounds, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(entries)
    some = (rng.integers(-2, 3, (120, 8)) / 4).tolist() + [[0.0] * 8] * 60  # few values: many ties
    rows = [(i % 150 if i % 40 else None, v, i % 3 if i % 5 else None) for i, v in enumerate(some)]
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] + [0.0] * 7, None), (504, some[0], 1), (504, some[0], 1)]
    df = spark.createDataFrame([(*r, "l", 9, "c") for r in rows], SCHEMA).repartition(3)
    assert found(df, entries=entries, rounds=rounds) == lloyd(rows, entries, rounds)


def test_heaps_spare_distances():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 16)) * 5
    x = vc.components(np.tile(centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 16)) * 0.1, 4))
    books, block, counts = vc.Codebooks(x[:40].reshape(40, 4, 16).transpose(1, 0, 2).copy()), vc.Block(x), []
    for _ in range(15):
        counts.append(block.settle(books))
        plain = np.array([vc.distances(block.part(p), books.entries[p]).argmin(axis=1) for p in range(4)]).T
        assert (block.codes() == plain).all()
        total = block.sums(40)
        books = books.moved(total[:, :, 0], total[:, :, 1:])
    assert counts[0] == 16_000 and counts[-1] < 4_000


def test_edges(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, None, "l", 1, "c")], SCHEMA)
    assert vc.compress(df.limit(0)).collect() == [] and vc.compress(df.withColumn("embedding", F.lit(None).cast("array<float>"))).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [(r["code"], r["error"]) for r in vc.compress(df).collect()] == [("00000000", 0)]
    for bad in ([[0.5] * 8, [0.5] * 12], [[0.5] * 7], [[1e30] * 8]):
        with pytest.raises(Exception, match="components|lengths"):
            vc.compress(spark.createDataFrame([(i, v, 1, "l", 1, "c") for i, v in enumerate(bad)], SCHEMA), entries=1).collect()
