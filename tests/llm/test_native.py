from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import ann, queries, queries_sql, sharding, url_filter
from tests.compare import both


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 10 or got != list(range(n))
    assert isqrt(n) >= 1


def test_shards(edges, edge_rows, nothing):
    rows = sharding.shard_documents(edges).collect()
    counts = [sum(r["shard"] == k for r in rows) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    crc = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == crc
    again = sharding.shard_documents(edges.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard_documents(nothing).count() == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_sharding", "op9_jaccard_join", "op10_url_filters"])
def test_matches_sql(spark, sf, name):
    got, wanted = both(spark, sf, queries.queries()[name], queries_sql.oracles()[name])
    assert got == wanted and got


ENTRIES = [("domain", "Bad.example", "add", 10), ("domain", "bad.example", "remove", 20), ("domain", "bad.example", "add", 30), ("host", "a.bad.example", "add", 15), ("prefix", "ok.example/x", "add", 0), ("prefix", "ok.example/y", "add", 5), ("prefix", "ok.example/y", "remove", 5), ("domain", None, "add", 1)]
CAPTURES = [(1, "http://a.bad.example/p", 9), (2, "http://a.bad.example/p", 10), (3, "http://u@A.BAD.example:80/p?q#f", 16), (4, "http://a.bad.example", 20), (5, "http://notbad.example/", 35), (6, "http://ok.example/x/z", 1), (7, "http://ok.example/xz", 1), (8, None, 1), (9, "nonsense", 1), (10, "http://bad.example./", 31), (11, "http://ok.example/y", 7), (12, "http://bad.example/", None), (1, "http://a.bad.example/p", 9)]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_ROWS, 0])
def test_urls_as_of_fetch(spark, limit):
    at = lambda c: F.timestamp_seconds(c)
    entries = spark.createDataFrame(ENTRIES, "kind string, entry string, action string, t int").withColumn("at", at("t"))
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, t int").withColumn("fetched_at", at("t")).withColumn("kind", F.lit("clash"))
    found = url_filter.filter_urls(captures, entries, limit).collect()
    assert len(found) == len(CAPTURES)
    assert {r["page_id"]: (r["blocked"], r["n_active"], r["entry"]) for r in found} == {
        1: (False, 0, None), 2: (True, 1, "bad.example"), 3: (True, 2, "a.bad.example"), 4: (True, 1, "a.bad.example"), 5: (False, 0, None), 6: (True, 1, "ok.example/x"),
        7: (False, 0, None), 8: (False, 0, None), 9: (False, 0, None), 10: (True, 1, "bad.example"), 11: (False, 0, None), 12: (False, 0, None),
    }
    assert url_filter.filter_urls(captures, entries.limit(0), limit).where("blocked").count() == 0
    assert url_filter.filter_urls(captures.limit(0), entries, limit).count() == 0


def test_very_long_urls_and_lists(spark):
    """A hot key, a path of many steps and an entry with many dates, by the list's long form."""
    at = lambda c: F.timestamp_seconds(c)
    entries = spark.range(400).select(F.lit("domain").alias("kind"), F.lit("hot.example").alias("entry"), F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"), at(F.col("id") * 10).alias("at"))
    url = F.concat(F.lit("http://www.hot.example/"), F.repeat(F.lit("ab/"), F.when(F.col("id") == 0, 3000).otherwise(1)))
    captures = spark.range(500).select(F.col("id").alias("page_id"), url.alias("url"), at(F.col("id") * 7 + 1).alias("fetched_at"))
    found = url_filter.filter_urls(captures, entries, 0).collect()
    assert {r["page_id"]: r["blocked"] for r in found} == {i: (i * 7 + 1) // 10 % 2 == 0 and i * 7 + 1 < 3990 for i in range(500)}


def test_very_long_text_in_a_shard(spark):
    docs = spark.range(9).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 3, F.repeat(F.lit("é"), 400_000)).otherwise("x").alias("text"))
    rows = {r["doc_id"]: r for r in sharding.shard_documents(docs).collect()}
    assert rows[3]["size"] == 800_001 and rows[3]["text_crc32"] == zlib.crc32(("é" * 400_000).encode())


def brute(vectors, k):
    out = {}
    for i, x in vectors:
        if i % 20 == 0:
            near = sorted(((-float(np.dot(x, y)), j) for j, y in vectors if j != i))[:k]
            out[i] = [j for _, j in near]
    return out


def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    monkeypatch.setattr(ann, "QUERY_ROWS", 60)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = ann.nearest(df).collect()
    vectors = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in df.collect()]
    wanted = brute(vectors, 20)
    got: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == wanted.keys()
    assert np.mean([len(set(got[q]) & set(wanted[q])) / len(wanted[q]) for q in wanted]) >= 0.9
    by_id = dict(vectors)
    assert all(r["score"] == pytest.approx(float(by_id[r["query_id"]] @ by_id[r["vec_id"]]), abs=1e-12) for r in rows)


def test_recall_of_a_full_shard():
    """16,384 vectors in 64 tight clusters, of uneven norms: every query finds most of its neighbours, none is lost."""
    rng = np.random.default_rng(8)
    n, size = ann.SHARD_ROWS, 64
    vectors = rng.normal(size=(64, size))[rng.integers(0, 64, n)] + 0.1 * rng.normal(size=(n, size))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)
    points, asked = ann.lifted(vectors), np.arange(0, n, 20)
    found = ann.search_graph(points, ann.build_graph(points), np.pad(vectors[asked], ((0, 0), (0, 1))), ann.SEARCH_BEAM)
    near = vectors[asked].astype(float) @ vectors.astype(float).T
    near[np.arange(asked.size), asked] = -np.inf
    wanted = np.argsort(-near, axis=1)[:, :20]
    recall = [len(set(f.tolist()) & set(w.tolist())) / 20 for f, w in zip(found, wanted, strict=True)]
    assert np.mean(recall) >= 0.95 and min(recall) > 0.5


def test_neighbour_edges(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]), (103, [1.0, None]), (120, [2.0, 0.0]), (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0]), (0, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    found = ann.nearest(df).collect()
    by = lambda q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert by(0) == [120, *range(1, 20)]
    assert by(20) == [120, *range(19)]
    assert by(120) == list(range(20))
    assert by(140) == [] and by(100) == []
    assert ann.nearest(df.limit(0)).count() == 0
