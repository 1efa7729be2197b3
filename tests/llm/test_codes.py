from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import codes, queries, queries_sql
from tests.compare import both


def nearest(x: list[int], entries: list[list[int]]) -> tuple[int, int]:
    apart = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return apart.index(min(apart)), min(apart)


def brute(rows: list[tuple], parts: int = 8, k: int = 16, rounds: int = 6) -> tuple[dict, str]:
    """(vec_id, label, components) to code and error, in plain loops."""
    size = len(rows[0][2]) // parts
    cut = [[r[2][p * size : (p + 1) * size] for p in range(parts)] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: rows[i][0])[:k]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            near = [nearest(x[p], books[p])[0] for x in cut]
            for e in range(len(first)):
                mine = [x[p] for x, n in zip(cut, near, strict=True) if n == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = {}
    for r, x in zip(rows, cut, strict=True):
        each = [nearest(x[p], books[p]) for p in range(parts)]
        found[r[0]] = "".join(f"{e:02x}" for e, _ in each), sum(d for _, d in each)
    return found, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=20), st.lists(st.lists(st.integers(-8, 8), min_size=2, max_size=2), min_size=1, max_size=30))
def test_orchard_search_is_exact_with_ties(entries, points):
    code, gap = codes.Codebook(np.array(entries)).assign(np.array(points))
    assert list(zip(code.tolist(), gap.tolist(), strict=True)) == [nearest(x, entries) for x in points]


def test_search_reads_less_than_everything(monkeypatch):
    rng = np.random.default_rng(3)
    entries = rng.integers(-1000, 1000, (256, 8))
    book, points = codes.Codebook(entries), entries[rng.integers(0, 256, 500)] + rng.integers(-20, 20, (500, 8))
    measured, plain = [], codes.squared
    monkeypatch.setattr(codes, "squared", lambda a, b: (measured.append(len(a)), plain(a, b))[1])
    code, _ = book.assign(points)
    assert code.tolist() == [nearest(x, entries.tolist())[0] for x in points.tolist()]
    assert sum(measured) < 0.5 * 256 * 500


def test_matches_sql_and_loops(spark, sf):
    got, wanted = both(spark, sf, queries.op13_vector_codes, queries_sql.oracles()["op13_vector_codes"])
    assert got == wanted and got
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], [int(np.floor(4096 * float(x))) for x in r["embedding"]]) for r in df.collect()]
    found, digest = brute(rows)
    out = {r["vec_id"]: r for r in codes.coded(df).collect()}
    assert {i: (r["code"], r["error"]) for i, r in out.items()} == found
    assert {r["codebooks_sha256"] for r in out.values()} == {digest}
    labels = {i: label for i, label, _ in rows}
    assert all(r["label_error"] == sum(e for j, (_, e) in found.items() if labels[j] == labels[i]) for i, r in out.items())


@pytest.mark.parametrize("limit", [codes.BROADCAST_ROWS, 0])
def test_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(codes, "BROADCAST_ROWS", limit)
    nan, inf = float("nan"), float("inf")
    vectors = [(209, [nan] * 8, 1), (210, [1.0] * 7 + [inf], 1), (211, None, 1), (212, [1.0, None] + [0.0] * 6, 1)]
    good = [(i, [float(i % 5) - 2] * 8, None if i % 3 == 0 else i % 3) for i in range(20)] + [(3, [1.0] * 8, 2), (None, [0.5] * 8, None), (30, [0.0] * 8, 7), (31, [1.0] * 3, 7), (32, [], 7), (33, [-1e-9] * 8, 7)]
    df = spark.createDataFrame(vectors + good, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("v", F.lit(1))
    out = codes.coded(df).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(str(i) for i, _, _ in good)
    by = {r["vec_id"]: r for r in out if r["vec_id"] != 3}
    assert len({(r["code"], r["error"]) for r in out if r["vec_id"] in (30, 32)}) == 1  # a vector without components is all zeros
    assert by[33]["code"] is not None and sum(r["error"] for r in out if r["vec_id"] in (30, 31, 32, 33)) == by[30]["label_error"] == by[33]["label_error"]
    assert codes.coded(df.limit(0)).count() == 0
    assert codes.coded(df.where("vec_id = 211")).count() == 0
    few = codes.coded(df.where("vec_id IN (1, 2)")).collect()
    assert {r["error"] for r in few} == {0} and {r["code"] for r in few} == {"00" * 8, "01" * 8}


def test_large_components_don_t_overflow(spark):
    rows = [(i, [float((-1) ** i * (i + 1) * 10.0**e)] * 8, 1) for i in range(6) for e in (0,)] + [(i + 10, [float((-1) ** i * 1e9 * (i + 1))] * 8, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, digest = brute([(i, lab, [int(np.floor(4096 * x)) for x in v]) for i, v, lab in rows])
    out = codes.coded(df).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in out} == {i: (c, min(e, codes.LARGEST)) for i, (c, e) in found.items()}
    assert out[0]["codebooks_sha256"] == digest


def test_decoded_vectors_differ_by_the_error(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows, books = codes.compress(df)
    back = codes.decoded(rows, books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in back:
        whole = np.floor(np.array(r["embedding"], np.float64) * 4096)
        assert int(((whole - np.array(r["vector"]) * 4096) ** 2).sum()) == r["error"]
