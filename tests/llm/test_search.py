"""Ranked lexical search against scores of all documents."""

import collections
import math
import re

import numpy as np
import pytest

from codeprism.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(docs, items, top=10):
    held = [(i, collections.Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, total = len(held), sum(k for *_, k in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        score = []
        for i, c, k in held:
            m = 25 + 75 * k * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            score.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in score if x[0] < 0)[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, top=10):
    d = spark.createDataFrame([(*r, "t", 1) for r in docs], "doc_id long, text string, term string, number long").repartition(3)
    q = spark.createDataFrame([(*r, "t", 1) for r in items], "item_id long, text string, term string, shard long")
    return sorted((tuple(r) for r in ls.rank_documents(d, q, top).collect()), key=repr)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = sorted((tuple(r) for r in ls.rank_documents(docs, items).collect()), key=repr)
    assert got == ranked([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


@pytest.mark.parametrize("shard,block,top", [(8192, 200_000, 10), (3, 4, 2), (16, 1, 40)])
def test_ties_nulls_and_repeats(spark, monkeypatch, shard, block, top):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard)
    monkeypatch.setattr(ls, "SHARD_TOKENS", 500)
    monkeypatch.setattr(ls, "QUERY_TERMS", block)
    rng = np.random.default_rng(shard)
    text = lambda n: " ".join(f"W{x}" for x in rng.zipf(1.6, n) if x < 200)
    docs = [(i, text(rng.integers(0, 30))) for i in range(200)] + [(300, None), (301, ""), (302, " ., !"), (303, "lang " * 5000 + "w3"), (None, "w7 w9"), (7, "ÀÉ é w9"), (7, "ÀÉ é w9")] + [(400 + i, "w1 w1 w2 same") for i in range(60)]
    items = [(0, "w1 W2"), (1, "w9 w9 w9 w7 é"), (2, None), (3, "unknown"), (4, "same"), (4, "same"), (None, "w3 lang"), (5, text(80))]
    assert found(spark, docs, items, top) == ranked(docs, items, top)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_hold():
    tf, m = (np.array(x, np.int64) for x in zip(*((t, m) for t in (1, 2, 5, 100, 10**6) for m in (25, 100, 350, 10**7, 10**10))))
    exact = ls.saturated(tf, m)
    byte = -(-exact * 255 // ls.LIMIT)
    assert (byte >= 0).all() and (byte <= 255).all() and (ls.UPPER[byte] >= exact).all() and (ls.LOWER[byte] <= exact).all()


def test_bounds_spare_scores(spark, monkeypatch):
    docs = [(i, f"common word{i % 50} " * (1 + i % 3)) for i in range(2000)]
    counted = []
    plain = ls.saturated
    monkeypatch.setattr(ls, "saturated", lambda tf, m: counted.append(len(tf)) or plain(tf, m))
    texts = [ls.terms_of(t.encode()) for _, t in docs]
    import pyarrow as pa

    rows = pa.Table.from_batches([b.append_column("k", pa.nulls(b.num_rows, pa.int32())) for b in ls._shard(0, pa.array(range(2000)), texts, 2000, sum(map(len, texts)))])
    terms_at = {t: i for i, t in enumerate(rows["term"].to_pylist()) if t}
    rows = rows.set_column(rows.column_names.index("k"), "k", pa.array([terms_at.get(t) for t in rows["term"].to_pylist()], pa.int32()))
    counted.clear()
    ls.Shard(rows).best([(terms_at[b"common"], 1), (terms_at[b"word7"], 3000)], 10)
    assert sum(counted) < 200
