"""Near copies of the pipeline against all pairs compared in full."""

import random

import numpy as np
import pytest

import corpus_pipeline
from codeprism.llm import near, simhash


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def alike(a, b):
    return 1.0 if not (a or b) else len(a & b) / len(a | b)


def smallest(texts):
    sets, root = {k: five(t or "") for k, t in texts.items()}, {k: k for k in texts}
    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return {k for k, r in root.items() if k == r}


def family(rng, size, length, least, most):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(least, most)):
            copy[rng.randrange(length)] = f"v{rng.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(4)
    texts = [t for _ in range(30) for t in family(rng, 3, rng.randint(50, 300), 1, 6)] + family(rng, 60, 120, 1, 3) + [None, "", "a b", "A B", "a b"]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    want = smallest(docs)
    assert kept == want


def test_sets_decide():
    sets = [set(range(100)), set(range(89)) | set(range(200, 211)), set(range(88)) | set(range(300, 312)), set(range(400, 410))]
    root = near.joined([np.array(sorted(s)) for s in sets])
    assert root[0] == root[1] and root[2] != root[0] and root[3] not in root[:3]


@pytest.mark.parametrize("crowd", [3, 20])
def test_crowds_are_dealt_to_blocks(spark, monkeypatch, crowd):
    monkeypatch.setattr(near, "CROWD", crowd)
    monkeypatch.setattr(near, "PIVOTS", (1, 2))
    rng = random.Random(crowd)
    texts = family(rng, 80, 60, 1, 2) + family(rng, 40, 200, 8, 16) + ["a b", None]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in near.keep_one(frame).collect()} == smallest(docs)


def test_wide_prints_and_chains():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    other = np.concatenate([base[:356], rng.integers(0, 1 << 63, 44, np.uint64)])
    a, b, c = (near.wide_print(x, 64) for x in (base, other, rng.integers(0, 1 << 63, 400, np.uint64)))
    share = lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)).sum() / 4096
    assert abs(share(a, b) - (1 - near.AGREE)) < 0.03 and abs(share(a, c) - 0.5) < 0.05
    keys, chain = near.ring(np.stack([a, b, c]), 18)
    bits = np.unpackbits(a.view(np.uint8), bitorder="little")
    assert keys[0, 3] == int("".join(map(str, bits[54:72])), 2) * keys.shape[1] + 3
    assert (np.unpackbits(chain[0, -1].view(np.uint8), bitorder="little") == np.roll(bits, -18 * keys.shape[1])[:128]).all()
    assert near.chained(chain[0], chain[1], 18).mean() > 0.99 > 0.01 > near.chained(chain[0], chain[2], 18).mean()


def test_null_ids_come_last(spark):
    frame = spark.createDataFrame([(None, "one text"), (7, "one text"), (5, "one text")], "doc_id long, text string")
    assert [r["doc_id"] for r in near.keep_one(frame).collect()] == [5]
    assert [r["doc_id"] for r in simhash.keep_one(frame).collect()] == [5]


@pytest.mark.parametrize("task_links", [7, 60, 1_000])
def test_components_of_links_over_many_tasks(spark, task_links):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 501), (500, 501), (7, 7), (-3, 2**62)]
    root = {k: k for k in {x for pair in links for x in pair}}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if r == old else r for k, r in root.items()}
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = sorted(map(tuple, simhash.components(frame, task_links).collect()))
    assert got == sorted((k, r) for k, r in root.items() if k != r)


def test_components_of_no_links(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
