"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeprism.llm import bpe, fingerprints, line_dedup, lm, packing, pii, quality, simhash, suffix_dedup, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, n long, text_h long, places string, host string, h long"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "word", "word " * 20_000, "A line. Another line.\nA line. Another line.\n" * 40, "é😀 " * 300, "+1 (017) 555-7713 a@b.cd 4111 1111 1111 1111, 1.2.3.4", "x" * 50_000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate([*texts, *texts])] + [(3, "word", "en", "s0", 4)] * 2 + [(None, "no id", None, None, None)] * 2
    return spark.createDataFrame([(*r, "r", 1, 2, 3, "p", "h", 5) for r in rows], SCHEMA)


WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
OPERATORS = {
    "lines": line_dedup.remove_boilerplate, "fingerprints": fingerprints.compare_versions, "suffix": suffix_dedup.remove_repeats,
    "simhash": simhash.group_documents, "pii": pii.find, "lm": lambda d: lm.score(d, symbols=50, table_bits=10), "bpe": lambda d: bpe.encode_documents(d, WORD), "quality": quality.judge,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each(odd, name):
    assert len(OPERATORS[name](odd).collect()) == odd.count()
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_packing(odd):
    pieces = packing.pack_documents(odd, BYTE).toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    assert pieces[pieces.doc_id == 0].doc_tokens.tolist() == [1]
    total = odd.select("text").toPandas().text.map(lambda t: len(packing.chunk_tokens(BYTE).encode(t or "")) // 4 + 1).sum()
    assert pieces.length.sum() == total and pieces.ids_crc32.notna().all()
    assert packing.pack_documents(odd.limit(0), BYTE).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://EXAMPLE.com/en/71?x", "http://example.com/en/8", "http://a.example.net/de/81", "http://b.net/de/8", "https://x.org/es", "http://spam-farm.io/", "http://spammer.io/", "http://a.io/cheap/pills", "http://a.io/cheap/cheap", "a://b://c"]
    out = url_filter.filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in out] == ["allow"] * 3 + ["allow", "block", "block", "allow", "allow", "block", "allow", "block", "allow", "allow"]
    assert [r["rule"] for r in out][3:7] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/"]
    assert (out[2]["host"], out[2]["path"], out[12]["host"]) == ("", "", "b:")


def test_url_terms_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", 1.5), ("so", 0.5), ("so", 0.2), ("la", 0.1), ("", 1.0), (None, 1.0), ("x", None)], "term string, weight double")
    strict, soft = url_filter.vocabulary(terms)
    assert (strict, soft) == (["bad"], ["la", "so"])
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["a://b/bad", "a://b/badly", "a://b/so", "a://b/so-la", "a://b/spam"])], "page_id long, url string")
    judged = lambda **k: [r["verdict"] for r in url_filter.filter_urls(pages, **k).orderBy("page_id").collect()]
    assert judged(strict=strict, soft=soft) == ["block", "allow", "allow", "block", "allow"]
    assert judged(strict=(), soft=()) == ["allow"] * 5
    assert url_filter.filter_urls(pages.limit(0)).count() == 0 and url_filter.filter_urls(pages.union(pages)).count() == 10


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages(spark, odd, name, stage):
    out = stage(spark, odd, "")
    assert out.dtypes == odd.dtypes
    rows = out.collect()
    assert name != "PII" or len(rows) == odd.count()
    assert stage(spark, odd.limit(0), "").count() == 0


def test_redaction(spark, odd):
    text = pii.redact(odd.where("doc_id = 7").limit(1)).first()["text"]
    assert text == "<PHONE> <EMAIL> <CARD>, <IP>"


def test_lines_keep_their_first_place(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nshared line", f"s{i}") for i in range(9)], "doc_id long, text string, source string")
    out = {r["row"]["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, min_sites=8).collect()}
    assert out[0] == "own 0\nshared line" and out[8] == "own 8"
    assert all(r["n_removed"] == 0 for r in line_dedup.remove_boilerplate(docs.where("doc_id < 7"), min_sites=8).collect())


def test_strict_host(spark):
    text = lambda i, more: " ".join(f"w{i}x{k}" for k in range(60)) + more
    rows = [(i, text(i, " #" * 9 if i % 20 == 0 or h == 3 and i % 2 else ""), f"h{h}") for h in range(10) for i in range(1000 * h, 1000 * h + 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r["doc_id"] for r in quality.judge(docs).where("NOT kept").collect()}
    assert gone == {i for i, t, h in rows if h == "h3" and t.endswith("#")}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {r[0] for r in rows} - gone


def test_bad_host_goes(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60)) if i % 100 else "bad", "good") for i in range(300)] + [(1000 + i, "bad" if i else " ".join(f"v{k}" for k in range(60)), "evil") for i in range(100)], "doc_id long, text string, source string")
    kept = quality.judge(docs).where("kept")
    assert kept.where("doc_id >= 1000").count() == 0 and kept.count() == 297


def test_bootstrapping_finds_unseen(spark):
    rows = [(i, f"call phone: +49 30 {1000000 + i} now") for i in range(30)] + [(i, f"call mail: u{i}@example.com now") for i in range(100, 140)] + [(500, "call mail: someone42(at)example now"), (501, "call other: 42foo now")]
    out = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[500] == "email:11:31" and out[501] == ""


def test_contexts_fold_blanks(spark):
    rows = [(0, "Please call your" + " " * 9 + "number: +49 30 1234567 \n\n\t right away now"), (1, "Please call your number: +49 30 1234567 right away now")]
    found = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id")).collect()
    patterns = [[(p["side"], p["pattern"]) for t in r["tokens"] for p in t["patterns"]] for r in found]
    assert patterns[0] == patterns[1] and ("L", "3<call your number:") in patterns[0]
