"""Operators that once did less than the whole job."""

import numpy as np
from pyspark.sql import functions as F

from codeprism.llm import fingerprints, lm


def test_lm_weights_learn_from_all_training_documents(spark):
    tokens = spark.range(25_000).select("id", F.lit(False).alias("held"), F.lit("a b").cast("binary").alias("text")).withColumnRenamed("id", "doc_id")
    model, _, n, _ = lm.train(tokens, symbols=5, table_bits=8)
    assert n == 75_000
    assert model.map.sum() == sum(model.code.size[i] * c for i, c in enumerate(model.counts))


def test_paragraphs_realign_after_an_insertion(spark):
    text = " ".join(f"Sentence {i} of this single line tells of matter {i * i}, and it ends here." for i in range(20))
    docs = spark.createDataFrame([(2, "A " + text), (1, text), (0, "...")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.compare_versions(docs).collect()}
    assert got[2]["near_next"] > 0.8
    assert got[1]["near_next"] == 0.0


def _coded_texts(docs):
    tokens = docs.select("doc_id", lm.held_out(F.col("doc_id")).alias("held"), F.col("text").cast("binary").alias("text"))
    model, _, n, _ = lm.vocabulary(tokens)
    rows = lm.stored(lm.coded(tokens, model, "held"))
    return model, rows, n


def test_lm_learning_lowers_held_out_loss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, rows, _ = _coded_texts(docs)
    start = model.weights.copy()
    model = lm.fitted(model, rows.where(~F.col("held")))
    held = [np.array(r["ids"]) for r in rows.where("held").collect()]
    loss = lambda: -sum(model.log10(ids, np.array([0])).sum() for ids in held)
    learned, moved = loss(), np.abs(model.weights - start).max()
    model.weights = start
    assert moved > 0.1 and learned < loss()  # measured: 0.7 % less here, 1.2 % less at sf0.1


def test_lm_contexts_run_on_in_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "a b c " * 3000), (2, "a c b " * 2000)], "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "BATCH", 1000)
    model, rows, _ = _coded_texts(docs)
    for ids in (np.array(r["ids"]) for r in rows.collect()):
        one, two = model.contexts(ids, np.array([0]))
        parts = [d for _, d in model.pieces(ids, np.array([0]))]
        assert len(parts) > 5 and (np.concatenate([d[2][2] for d in parts]) == model.decisions(ids, one, two)[2][2]).all()
    assert all(x < 0 for x in whole.values())


def test_lm_tables_grow():
    assert lm.sized(3_200_000) == (65_536, 18) and lm.sized(64_000_000) == (262_144, 20) and lm.sized(10**14) == (lm.MAX_SYMBOLS, lm.MAX_TABLE_BITS)
