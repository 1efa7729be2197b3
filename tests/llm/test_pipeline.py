from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm.common import stored
from tests.llm.test_jaccard_join import brute
from tests.llm.test_suffixes import passages


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf)))
    return kept


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = stages[1].join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    assert clean >= 0.98 * stages[0].join(labels.where("toxic = 0"), "doc_id", "left_semi").count()
    assert stages[1].count() < stages[0].count()


def test_one_of_each_class_stays(stages):
    least = {c for _, c, _, _ in brute(texts(stages[1]))}
    assert sorted(i for i, _ in texts(stages[2])) == sorted(least)


def test_repeated_passages_go(stages):
    rows = [(i, (t or "").encode()) for i, t in texts(stages[2])]
    spans = {i: w for (i, _), w in zip(rows, passages(rows), strict=True)}
    left = dict(texts(stages[3]))
    assert sum(map(len, spans.values())) > 20
    for i, text in rows:
        gone = sum(e - b for b, e in spans[i])
        if not gone:
            assert (left[i] or "").encode() == text
        elif gone < len(text):
            assert abs(len(left[i].encode()) - len(text) + gone) <= 12
        else:
            assert i not in left


def test_mixing_keeps_every_document(stages):
    assert {i for i, _ in texts(stages[4])} == {i for i, _ in texts(stages[3])}
    assert stages[4].count() >= stages[3].count()


def test_encoding_is_of_what_was_left(stages):
    got = sorted((r["doc_id"], r["decoded_sha256"]) for r in stages[5].collect())
    assert got == sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts(stages[4]))


def test_run_is_the_stages(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).agg(F.count("*"), F.sum("n_tokens")).first() == stages[5].agg(F.count("*"), F.sum("n_tokens")).first()


def test_stages_carry_edge_rows_and_any_column(spark, edges, nothing, sf):
    """Null, empty, blank, very long and repeated rows, and columns named as the stages name their own."""
    names = ["_key", "_id", "_crc", "_own_crc", "_copy", "row", "key", "doc", "kept", "first", "copies", "rated", "spans", "n_removed", "at", "n_spans", "crc", "copy", "_doc", "_at"]
    for docs, rows in ((edges.drop("key", "id", "score", "size", "path"), edges.count()), (nothing.drop("key", "id", "score", "size", "path"), 0)):
        for name in names:
            docs = docs.withColumn(name, F.lit(1))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stored(stage(spark, docs, sf))
            assert left.columns == docs.columns
            assert left.count() <= 2 * rows
            docs = left
        assert {1, 3, 6} & {r["doc_id"] for r in docs.collect()} == ({1, 3, 6} if rows else set())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
