from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
CARD, OTHER = "4111 1111 1111 1111", "5500-0055-5555-5559"


def luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (1 + place % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    """Spans by the patterns as they are written."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="a1@.-+ 2(5)é٣", max_size=40), st.lists(st.sampled_from([CARD, "a@b.co", "@", ".", "+1 (234) 555-0199", "10.0.0.7", "256.1.1.1", " ", "-", "0", "x", "..", "a.b@c", "é"]), max_size=9).map("".join)))
def test_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "+1 " * 100_000, ".a@b" * 80_000])
def test_long_texts_in_linear_time(text):
    assert len(pii.base_spans(text)) <= len(text)


def cuts(n, entities, at=0):
    """All cuts of n tokens into the given (first, last, kind) and single tokens."""
    if at == n:
        yield []
        return
    for rest in cuts(n, entities, at + 1):
        yield rest
    for e in entities:
        if e[0] == at:
            for rest in cuts(n, entities, e[1]):
                yield [e, *rest]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="a1.@ ", min_size=1, max_size=7), st.integers(0, 1000))
def test_best_cut_and_probabilities_by_enumeration(text, seed):
    weights = np.random.default_rng(seed).normal(0, 0.4, (int(pii.OFFSETS[-1]), len(pii.KINDS))).astype(np.float32)
    t = pii.tokens([text])
    c = pii.candidates(t)
    scores = pii.score(weights, c)
    entities = [(int(a), int(b), k) for a, b in zip(c.first, c.last, strict=True) for k in range(len(pii.KINDS))]
    value = {(int(c.first[i]), int(c.last[i]), k): float(scores[i, k]) for i in range(c.first.size) for k in range(len(pii.KINDS))}
    every = [(sum(value[e] for e in cut), cut) for cut in cuts(t.kind.size, entities)] if len(entities) <= 80 else []
    if every:
        best = sum(g for *_, g in pii.best_path(t, weights))
        assert best == pytest.approx(max(v for v, _ in every), abs=1e-4)
        chance, log_sum = pii.joint(t, c, scores)
        total = sum(np.exp(v) for v, _ in every)
        assert log_sum == pytest.approx(np.log(total), abs=1e-3)
        for i in range(c.first.size):
            for k in range(len(pii.KINDS)):
                share = sum(np.exp(v) for v, cut in every if (int(c.first[i]), int(c.last[i]), k) in cut) / total
                assert chance[i, k] == pytest.approx(share, abs=1e-3)


def test_blocks_of_tokens_give_the_same(monkeypatch):
    weights = np.random.default_rng(2).normal(0, 0.4, (int(pii.OFFSETS[-1]), len(pii.KINDS))).astype(np.float32)
    t = pii.tokens(["ab 12.3 @ 45-6 (7) x+8 " * 40, "9 a@b.c"])
    whole = pii.best_path(t, weights)
    monkeypatch.setattr(pii, "BLOCK", 7)
    assert pii.best_path(t, weights) == whole and whole


@cache
def labelled(seed):
    """Windows of made-up prose with personal data in the forms of the patterns, and with other numbers."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abdeghilmnorstu"), int(rng.integers(2, 8))))
    out = []
    for _ in range(400):
        kind = int(rng.integers(6))
        digits = [int(x) for x in rng.integers(0, 10, 15)]
        check = (-sum(x // 10 + x % 10 for i, d in enumerate(digits[::-1]) for x in [d * (2 - i % 2)])) % 10
        card = "".join(map(str, [*digits, check]))
        item = [f"{word()}.{rng.integers(10, 99)}@{word()}.example.com", ".".join(str(x) for x in rng.integers(1, 255, 4)), card, f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}", f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"key {bytes(rng.integers(0, 255, 12).tolist()).hex()}"][kind]
        text = " ".join([*[word() for _ in range(9)], item, *[word() for _ in range(9)]])
        out.append((text, pii.base_spans(text)))
    return out


@cache
def field():
    return pii.fit(labelled(1)[:250])


def scored(pieces):
    found = pii.further([p for p, _ in pieces], field(), [[] for _ in pieces])
    right = sum(len(set(f) & set(w)) for f, (_, w) in zip(found, pieces, strict=True))
    return right / max(1, sum(map(len, found))), right / sum(len(w) for _, w in pieces)


def test_held_out_spans_are_found_by_the_field_alone():
    precision, recall = scored([(p, pii.apart(s)) for p, s in labelled(7)])
    assert precision > 0.95 and recall > 0.9


def test_disguised_spans_are_found():
    rng = np.random.default_rng(3)
    precision, recall = scored([pii.disguised(p, pii.apart(s), rng) for p, s in labelled(8)])
    assert precision > 0.9 and recall > 0.85


def test_what_the_patterns_swallow():
    """Two cards in a row are one match of 32 digits, which fails; the field cuts it."""
    text = "no mo 4111111111111111 4111111111111111 end"
    assert pii.base_spans(text) == []
    assert pii.further([text], field(), [[]]) == [[(2, 6, 22), (2, 23, 39)]]


def test_rows(spark, edges, edge_rows, nothing):
    extra = [(50, f"call +1 (377) 555-0271 or mail a.b@c.example.com\nfrom 10.1.2.3 or pay {CARD}"), (51, "é" * 70 + " a@b.co"), (51, "é" * 70 + " a@b.co"), (52, ("word 12345 " * 20_000) + "x@y.zz"), (None, "1.2.3.4")]
    df = edges.unionByName(spark.createDataFrame([(i, t, "xx", "s", len(t), "k", 7, 0.5, 3, "p") for i, t in extra], edges.schema)).withColumn("spans", F.lit("clash"))
    rows = pii.personal_data(df).collect()
    wanted = []
    for i, t in edge_rows + extra:
        spans = plain(t or "")
        counts = [sum(s[0] == k for s in spans) for k in pii.KINDS]
        wanted.append((i, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r[:6]) for r in rows), key=key) == sorted(wanted, key=key)
    for r in rows:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert len(spans) == r["n_added"] + sum(r[f"n_{k}"] for k in pii.KINDS)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1]), int(s[2])))
    assert pii.personal_data(nothing).count() == 0
    assert pii.personal_data(df.where("text IS NULL")).agg(F.sum("n_added")).first()[0] == 0


def test_query_keeps_every_base_span(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_pii(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = [":".join(map(str, s)) for s in plain(texts[r["doc_id"]])]
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_redacted():
    text = f"a@b.co and {CARD}."
    assert pii.redacted(text, pii.base_spans(text)) == "[email] and [card]."
    assert pii.redacted("none", []) == "none"
