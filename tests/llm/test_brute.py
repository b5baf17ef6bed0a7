"""Operators against plain computations on small fixtures."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from codeprism.llm import bpe, fingerprints, line_dedup, lm, packing, simhash, suffix_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001/documents.parquet"
SPECIAL = ["", " ", "a<|startoftext|>b <|endoftext|>", "it's ÉCOLE ΣΑΣ’ Straße \x1cx\x1d 12 3é 日本語　テスト 😀👍🏽 İ", "don't DON'T 'S 's're", "\x85a\xa0b​c", "ﬁﬂ Ⅷ ½ a\u0000b", "x" * 500, "a  b \n  c\t\td", "é" * 100]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF).select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r[0], r[1]) for r in docs.orderBy("doc_id").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))


def test_interval_expansion():
    random.seed(3)
    for length in (5, 9, 40):
        for trial in range(30):
            some = [bytes(random.choice(b"ab" if trial % 2 else b"abc\x00\xff") for _ in range(random.randint(0, 60))) for _ in range(6)] + [b"abab" * 20] * (trial % 3)
            begins, repeated, sample = suffix_dedup.repeated_starts(some, length)
            count = collections.Counter(t[i : i + length] for t in some for i in range(len(t) - length + 1))
            for t, at in zip(some, begins):
                want = [count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)]
                assert list(repeated[at : at + len(want)]) == want
            assert sample.sum() == sum(v > 1 for v in count.values())


@pytest.mark.parametrize("blocks", [16, 2048])
def test_suffix_dedup(spark, docs, texts, monkeypatch, blocks):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", blocks)
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8)))
    core = " ".join(word() for _ in range(100))
    some = [" ".join(word() for _ in range(random.randint(0, 40))) + core + " ".join(word() for _ in range(random.randint(0, 40))) for _ in range(60)] + [None, "", core, core, "x" * 1500, "ab" * 700, core[:399], core[:400]]
    rows = list(enumerate(some)) if blocks == 16 else texts
    count = collections.Counter(t[i : i + 400] for _, x in rows for t in [(x or "").encode()] for i in range(len(t) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, x in rows:
        t = (x or "").encode()
        gone, end = np.zeros(len(t), bool), 0
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[max(i, end) : i + 400], end = True, i + 400
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())


def test_simhash(docs, texts):
    got = {r[0]: r for r in simhash.group_documents(docs).collect()}
    prints = {}
    for k, x in texts:
        w = words(x)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        ones = sum((np.array([xxhash.xxh64(s.encode(), seed=42).intdigest() >> i & 1 for i in range(64)]) for s in shingles), np.zeros(64, int))
        prints[k] = sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))
        assert got[k]["fingerprint"] == f"{prints[k]:016x}"
    root = {k: k for k in prints}
    for _ in range(8):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {k: r["component_id"] for k, r in got.items()} == root


def test_forest_of_large_places():
    random.seed(1)
    own = np.array(sorted({random.getrandbits(11) << 43 for _ in range(700)}), np.int64)
    small, links = simhash._forest(own[:40], own[40:60] ^ 4), simhash._forest(own, np.zeros(0, np.int64))
    assert all((a ^ b).bit_count() <= 2 for a, b in links + small)
    root = {int(x): int(x) for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for b in own[i + 1 :][np.bitwise_count((own[i + 1 :] ^ a).view(np.uint64)) <= 2]:
            root[find(int(a))] = find(int(b))
    groups = len({find(int(x)) for x in own})
    assert len(own) - len(links) == groups


def test_bpe(texts):
    some = [x for _, x in texts] + SPECIAL
    path = public_tokenizers.path("word_bpe_49k.json")
    own, other = bpe.WordBpe(path), tokenizers.Tokenizer.from_file(path)
    other.no_padding(), other.no_truncation()
    out = [y for batch in bpe.in_batches(some) for y in own.encode(batch)]
    for (ids, shown), e in zip(out, other.encode_batch(some, add_special_tokens=False)):
        assert ids == struct.pack(f"<{len(e.ids)}I", *e.ids)
        assert shown == other.decode(e.ids, skip_special_tokens=False) == own.decode(e.ids)


def test_packing(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, other = packing.ChunkTokens(path), tokenizers.Tokenizer.from_file(path)
    some = [x for _, x in texts] + SPECIAL
    ids = [e.ids for e in other.encode_batch(some, add_special_tokens=False)]
    assert [coder.encode(x) for x in some] == [np.array(i, "<u4").tobytes() for i in ids]
    own = {k: i + [0] for (k, _), i in zip(texts, ids)}
    pieces = packing.pack_documents(docs, path).toPandas()
    for p in pieces.itertuples():
        assert zlib.crc32(np.array(own[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(own[p.doc_id])
    for by, at in (("doc_id", "start"), ("sequence_id", "offset")):
        ordered = pieces.sort_values([by, at])
        assert (ordered.groupby(by).length.cumsum() - ordered.length == ordered[at]).all()
    full = pieces.groupby("sequence_id").length.sum()
    assert pieces.length.sum() == sum(map(len, own.values())) and all(n == 1024 or n & (n - 1) == 0 for n in full)


def test_column_generation():
    demand = {k: 1000 - 7 * k for k in range(1, 64)}
    patterns = packing.fill_patterns(demand, 64)
    used = collections.Counter()
    for p, times in patterns:
        assert sum(r * n for r, n in p.items()) == 64
        used.update({r: n * times for r, n in p.items()})
    assert all(used[r] <= demand[r] + 1e-6 for r in used)
    assert sum(t for _, t in patterns) > 0.97 * sum(r * n for r, n in demand.items()) / 64


def test_fingerprints(spark, docs, texts):
    digest = lambda x: {xxhash.xxh64(p.encode(), seed=42).intdigest() for p in re.findall(fingerprints.PARAGRAPH, x)}

    def shown(items):
        third, cells = fingerprints.PRINT_CELLS // 3, [[0, 0, 0] for _ in range(fingerprints.PRINT_CELLS)]
        for d in items:
            check = xxhash.xxh64(struct.pack("<Q", d), seed=42).intdigest()
            for k in range(3):
                c = cells[k * third + (d >> 34 + 10 * k & 1023) % third]
                c[0], c[1], c[2] = c[0] + 1, c[1] ^ d, c[2] ^ check
        return "".join(f"{n:08x}{k:016x}{h:016x}" for n, k, h in cells)

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r["doc_id"]: r for r in fingerprints.compare_versions(docs).collect()}
    order = texts[::-1]
    for i, (k, x) in enumerate(order):
        y, half = order[(i + 1) % len(order)][1], len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        assert got[k]["fingerprint"] == shown(digest(x)) and got[k]["edited_fingerprint"] == shown(digest(edited))
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(x)
        assert got[k]["near_edited"] == pytest.approx(like(digest(x), digest(edited))) and got[k]["near_next"] == pytest.approx(like(digest(x), digest(y)))
    by_text = collections.defaultdict(set)
    for k, x in texts:
        by_text[x].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_ranges_of_ids(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    monkeypatch.setattr(fingerprints, "FANOUT", 5)
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs).collect()}
    for i, (k, x) in enumerate(texts):
        assert got[k]["text"] == x and got[k]["next_text"] == texts[i - 1][1]


def test_lm(docs, texts):
    got = lm.score(docs).toPandas().set_index("doc_id")
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in texts}
    count = collections.Counter(w for k, x in texts if not held[k] for w in [*words(x), None])
    n, v = sum(count.values()), len(count)
    for k, x in texts:
        w = [*words(x), None]
        row = got.loc[k]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[k], len(w), sum(count[t] > 0 for t in w), n)
        assert row.base_score == pytest.approx(sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w))
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_code_is_a_distribution():
    code = lm.Code([5.0, 3.0, 1.0, 1.0, 0.5])
    assert sum(2.0 ** -s for s in code.size) == 1


@pytest.mark.parametrize("broadcast_rows", [line_dedup.BROADCAST_ROWS, 0])
def test_line_dedup_joins(spark, monkeypatch, broadcast_rows):
    """Broadcast and split joins give the plain result, with a hot line, lines about the threshold and a null source."""
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 0)
    rows = [(i, "\n".join(["hot line"] * (1 + i % 3) + [f"on {n} sites" for n in range(5, 12) if i % 12 < n] + [" ", f"own {i}"]), f"s{i % 12}" if i % 12 else None) for i in range(120)]
    sites, first = {}, {}
    for doc, text, source in rows:
        for place, line in enumerate(text.split("\n")):
            sites.setdefault(line.strip(), set()).add(source)
            first.setdefault(line.strip(), (doc, place))
    expected = {doc: "\n".join(x for p, x in enumerate(text.split("\n")) if not x.strip() or len(sites[x.strip()]) < 8 or first[x.strip()] == (doc, p)) for doc, text, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = {r["row"]["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, broadcast_rows=broadcast_rows).collect()}
    assert out == expected and "hot line" not in out[5] and "on 7 sites" in out[13]
