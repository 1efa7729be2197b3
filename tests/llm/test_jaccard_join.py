from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillstream.llm import jaccard_join
from quillstream.llm.graph import connected
from quillstream.llm.shingles import shingles
from tests.llm.conftest import prose


def sets(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (class, links, copies), by position in ``rows``."""
    texts = sorted({t or "" for _, t in rows})
    made = [sets(t) for t in texts]
    up, links = list(range(len(texts))), [0] * len(texts)
    for a, b in combinations(range(len(texts)), 2):
        both = len(made[a] & made[b])
        if both and 5 * both >= 4 * (len(made[a]) + len(made[b]) - both):
            links[a], links[b] = links[a] + 1, links[b] + 1
            old, new = up[a], up[b]
            up = [new if x == old else x for x in up]
    place = {t: i for i, t in enumerate(texts)}
    members = {}
    for i, t in rows:
        members.setdefault(up[place[t or ""]], []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    copies = {t: sum((x or "") == t for _, x in rows) for t in texts}
    return [(i, least[up[place[t or ""]]], links[place[t or ""]], copies[t or ""]) for i, t in rows]


def same(got, wanted):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(wanted, key=key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t", max_size=40), min_size=1, max_size=5))
def test_shingles_are_the_sets(texts):
    hashes, bounds = shingles([t.encode() for t in texts])
    seen = {}
    for k, t in enumerate(texts):
        mine = set(hashes[bounds[k] : bounds[k + 1]].tolist())
        assert len(mine) == len(sets(t))
        for s in sets(t):
            seen.setdefault(s, set()).update(mine if len(sets(t)) == 1 else ())
    assert all(len(v) <= 1 for v in seen.values())


def test_edge_rows(edges, edge_rows):
    same(jaccard_join.join_near_texts(edges).collect(), brute(edge_rows))


def test_groups_of_near_copies(spark, monkeypatch):
    """A large group, in several blocks and parts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LARGE", 20)
    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(rng, 40)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_join.join_near_texts(df).collect(), brute(rows))


def test_keep_one(edges, nothing):
    kept = jaccard_join.keep_one_of_class(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 8 not in ids and 7 not in ids and 15 not in ids
    assert {6, 10, 11, 12, 13, 14, 16, 17, 18, 19} <= set(ids) and None in ids
    assert jaccard_join.keep_one_of_class(nothing).count() == 0
    assert jaccard_join.join_near_texts(nothing).count() == 0


def test_leaders_span_a_bucket():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    codes = np.stack([np.where(rng.random(64) < 0.03, rng.integers(0, 256, 64), base).astype(np.uint8) for _ in range(600)])
    links, leaders = jaccard_join.bucket_links(codes)
    assert len(links) == 599
    assert len(leaders) < 600


def test_pairs_in_large_buckets_are_found(spark, monkeypatch):
    """Every bucket counts as large and is split as far as it goes; pairs agree in 51 of 64 coordinates."""
    monkeypatch.setattr(jaccard_join, "LARGE", 1)
    rng, n = np.random.default_rng(2), 3000
    left = rng.integers(0, 2**32, (n, 64), dtype=np.uint32)
    right = left.copy()
    for i in range(n):
        right[i, rng.permutation(64)[:13]] += np.uint32(1)
    rows = [(2 * i + k, bytearray(m[i].tobytes())) for i in range(n) for k, m in enumerate((left, right))]
    links = jaccard_join.candidate_links(spark.createDataFrame(rows, "id long, sketch binary")).distinct().collect()
    found = {min(r["a"], r["b"]) // 2 for r in links if abs(r["a"] - r["b"]) == 1}
    assert n - len(found) <= 1


def test_links_behind_a_leader_in_large_buckets(spark):
    """Threes of texts, all with one passage: the second is linked to the third, but a leader stands for it that is not."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    shared, rows, threes = [word() for _ in range(90)], [], []

    def changed(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(90, len(out))] = word()
        return out

    def alike(a, b):
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    while len(threes) < 500:
        leader = shared + [word() for _ in range(110)]
        near = changed(leader, 1)
        far = changed(near, rng.choice([3, 4]))
        if alike(near, far) >= 0.8 > alike(leader, far):
            threes.append(range(len(rows), len(rows) + 3))
            rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((leader, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in jaccard_join.join_near_texts(docs).collect()}
    assert len(rows) > jaccard_join.LARGE and all(found[i] == three[0] for three in threes for i in three)


def test_small_graphs_take_few_tasks(spark):
    """A step over few rows starts as many tasks as they need, however many shuffle partitions there are."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = connected(chain.union(spark.range(500, 600).select(F.col("id").alias("a"), F.lit(500).cast("long").alias("b"))))
        assert len(found.inputFiles()) == 1
        roots = {r["node"]: r["root"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(roots) == {*range(201), *range(500, 600)}
    assert len({roots[n] for n in range(201)}) == 1 and len({roots[n] for n in range(500, 600)}) == 1 and roots[0] != roots[500]
