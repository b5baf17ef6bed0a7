"""The whole pipeline on the smallest tables, each stage against a plain computation on its own input."""

import collections
import re

import pytest

import corpus_pipeline
from codeprism.llm import line_dedup, packing, pii, quality
from tests.llm.test_near import smallest

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
    return len(w) < quality.MIN_WORDS or 100 * len(covered) > quality.MAX_REPEAT_PERCENT * len(w)


def without_lines(rows):
    """doc_id: text without lines of many sites but where they stand first."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, first = collections.defaultdict(set), {}
    for i, text, source in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            if strip(line):
                sites[strip(line)].add(source)
                first.setdefault(strip(line), (i, n))
    gone = lambda i, n, line: strip(line) and len(sites[strip(line)]) >= line_dedup.MIN_SITES and first[strip(line)] != (i, n)
    return {i: "\n".join(line for n, line in enumerate((text or "").split("\n")) if not gone(i, n, line)) for i, text, _ in rows}


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage, seen = dict(corpus_pipeline.STAGES), [docs]
    for name in ("quality rules", "line dedup", "SimHash near-dedup", "PII"):
        out = stage[name](spark, seen[-1], SF)
        assert out.dtypes == docs.dtypes
        seen.append(out.cache())
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen]
    assert set(rows[1]) == {i for i, r in rows[0].items() if not base_failed(r["text"])}
    assert {i: r["text"] for i, r in rows[2].items()} == without_lines([(i, r["text"], r["source"]) for i, r in rows[1].items()])
    assert set(rows[3]) == smallest({i: r["text"] for i, r in rows[2].items()})
    assert set(rows[4]) == set(rows[3]) and all(r["n_chars"] == len(r["text"]) for r in rows[4].values())
    assert pii.find(seen[4]).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    coder = packing.chunk_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(coder.encode(r["text"])) // 4 + 1 for i, r in rows[4].items()}
    assert pieces.groupby("doc_id").length.sum().to_dict() == tokens == pieces.groupby("doc_id").doc_tokens.first().to_dict()
    assert (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    for d in seen[1:]:
        d.unpersist()
