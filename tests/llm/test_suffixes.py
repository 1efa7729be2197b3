from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import suffix_dedup, suffixes

contents = st.lists(st.text(alphabet="ab", max_size=40).map(str.encode) | st.binary(max_size=30).map(lambda b: bytes(min(x, 244) for x in b)), min_size=1, max_size=6)


def repeated(texts, n, copies, lo, hi):
    counts, owners = Counter(), {}
    for k, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            counts[t[i : i + n]] += copies[k]
            owners.setdefault(t[i : i + n], set()).update([lo[k], hi[k]])
    out = set()
    for k, t in enumerate(texts):
        for across, holds in ((False, lambda w: counts[w] > 1), (True, lambda w: len(owners[w]) > 1)):
            flags = [False, *(i <= len(t) - n and holds(t[i : i + n]) for i in range(len(t))), False]
            edges = [i for i in range(len(flags) - 1) if flags[i] != flags[i + 1]]
            out |= {(k, b, e - 1 + n, across) for b, e in zip(edges[::2], edges[1::2], strict=True)}
    return {r for r in out if r[3] or (*r[:3], True) not in out}


def held_against_loop(texts, n, seed):
    rng = np.random.default_rng(seed)
    copies, lo = rng.integers(1, 3, len(texts)), rng.integers(0, 3, len(texts))
    hi = lo + (copies > 1) * rng.integers(0, 2, len(texts))
    found = list(zip(*(c.tolist() for c in suffixes.repeated_runs(texts, n, copies, lo, hi)), strict=True))
    assert len(set(found)) == len(found) and set(found) == repeated(texts, n, copies, lo, hi)


@settings(max_examples=150, deadline=None)
@given(contents, st.integers(1, 8), st.integers(0, 9))
def test_repeated_runs(texts, n, seed):
    held_against_loop(texts, n, seed)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", max_size=60))
def test_order_and_prefixes(text):
    data = text.encode() + b"\0"
    parts = list(suffixes.ordered_suffixes(np.frombuffer(data, np.uint8), 1000))
    positions = np.concatenate([p for p, _ in parts]).tolist()
    assert positions == sorted(range(len(data)), key=lambda i: data[i:])
    prefixes = np.concatenate([x for _, x in parts]).tolist()
    for a, b, n in zip(positions, positions[1:], prefixes[1:], strict=False):
        assert data[a : a + n] == data[b : b + n]
        assert data[a : a + n + 1] != data[b : b + n + 1]


def test_queues_on_disk(monkeypatch):
    monkeypatch.setattr(suffixes, "IN_MEMORY", 100)
    monkeypatch.setattr(suffixes, "RUN", 16)
    texts = [b"abracadabra" * 9, b"cadabra" * 7, b"xyz" * 20]
    held_against_loop(texts, 9, 1)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=2, max_size=70), st.integers(2, 9), st.integers(2, 8))
def test_names_are_sorted_by_recursion(values, run, base):
    """Every level in files, down to a few names."""
    names = np.unique(np.array([*values, 0]), return_inverse=True)[1].astype(np.int64)
    old = suffixes.IN_MEMORY, suffixes.RUN
    suffixes.IN_MEMORY, suffixes.RUN = base, run
    try:
        found = np.array(suffixes.sort_names(names, int(names.max()) + 1, 1000)).tolist()
    finally:
        suffixes.IN_MEMORY, suffixes.RUN = old
    assert found == sorted(range(names.size), key=lambda i: names[i:].tolist())


def test_a_shard_many_times_the_memory(monkeypatch):
    """64 times IN_MEMORY, through at least one recursion in files, with all temporary files gone at the end."""
    rng = np.random.default_rng(6)
    base = bytes(rng.integers(97, 110, 3000).astype(np.uint8))
    texts = [base[k : k + 700] + bytes(rng.integers(97, 123, 300).astype(np.uint8)) for k in range(0, 2300, 36)]
    n = sum(map(len, texts))
    plain = suffixes.repeated_runs(list(texts), 100, np.ones(len(texts), int), np.arange(len(texts)), np.arange(len(texts)))
    made, sorted_in_files = [], []
    keep = suffixes.induced_order
    monkeypatch.setattr(suffixes, "induced_order", lambda *a: sorted_in_files.append(a[0].size) or keep(*a))
    close = suffixes.Arrays.close
    monkeypatch.setattr(suffixes.Arrays, "close", lambda self: made.append(self.folder) or close(self))
    monkeypatch.setattr(suffixes, "IN_MEMORY", n // 64)
    monkeypatch.setattr(suffixes, "RUN", 512)
    found = suffixes.repeated_runs(list(texts), 100, np.ones(len(texts), int), np.arange(len(texts)), np.arange(len(texts)))
    assert sorted(map(tuple, np.stack(found, axis=1).tolist())) == sorted(map(tuple, np.stack(plain, axis=1).tolist()))
    assert len(plain[0]) > 50 and sorted_in_files
    assert not any(f is not None and os.path.exists(f.name) for f in made)


def expected(texts):
    counts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 800, 0])
def test_matches_brute_force(edges, edge_rows, hot):
    got = suffix_dedup.remove_repeats(edges, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    wanted = expected([(t or "").encode() for _, t in edge_rows])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *w) for (i, _), w in zip(edge_rows, wanted, strict=True)), key=key)
    assert sum(w[1] for w in wanted) > 5000


def test_counted_windows_of_a_shared_passage(spark):
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = words(90)
    rows = [(i, f"{words(20 + i % 7)} {passage if i % 2 else passage[i : i + 500]} {words(15)}") for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, rows[0][1])], "doc_id long, text string")
    wanted = expected([t.encode() for _, t in [*rows, (40, rows[0][1])]])
    for hot in (0, 5000, suffix_dedup.HOT):
        found = suffix_dedup.remove_repeats(docs, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
        assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == wanted


def test_long_texts_are_cut_with_overlap(edges, edge_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONGEST", 700)
    data = b"".join(bytes([97 + (i * i) % 23]) for i in range(3000))
    whole = suffix_dedup.stretches(*suffix_dedup.joined([data]))
    assert (whole[2] - 399).sum() == len(data) - 399
    test_matches_brute_force(edges, edge_rows, suffix_dedup.HOT)


def test_empty_table_and_texts(nothing, edges):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.remove_passages_from_texts(nothing).count() == 0
    kept = suffix_dedup.remove_passages_from_texts(edges)
    assert kept.columns == edges.columns
    found = {r["doc_id"]: r for r in kept.collect()}
    assert 1 not in found and 2 not in found
    assert found[6]["text"] == "one two" and found[3]["text"] is None
    assert all(r["n_chars"] == len(r["text"] or "") for r in found.values())
    passage = found[10]["text"].split()
    assert len(passage) < 65 and len(found[11]["text"].split()) < 45


def passages(rows, least=250, words=50):
    """By plain loops: the runs of over 50 words that other documents have too, for every row."""

    def strings(t):
        yield from ((k, k + least) for k in range(len(t) - least + 1))
        found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        yield from ((a, b) for (a, _), (_, b) in zip(found, found[words:]) if b - a < least)

    owners = {}
    for i, t in rows:
        for a, b in strings(t):
            owners.setdefault(t[a:b], set()).add((i, t))
    out = []
    for _, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for a, b in strings(t):
            if len(owners[t[a:b]]) > 1:
                gone[a + 1 : b + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).reshape(-1, 2)
        out.append([(b, e) for b, e in edges.tolist() if len(re.findall(rb"[^\x20\x09-\x0D]+", t[b:e])) > words])
    return out


@pytest.mark.parametrize("longest", [suffix_dedup.LONGEST, 400, 251])
def test_windows_of_short_words(monkeypatch, longest):
    monkeypatch.setattr(suffix_dedup, "LONGEST", longest)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab \né"), int(n))) for n in (0, 3, 90, 500, 3000, 1200, 2600)] + ["a " * 51, "a " * 50, "x" * 400, " b" * 700]
    texts = [t.encode() for t in texts]
    text, begin, size, one, two = suffix_dedup.word_windows(texts, 250)
    found = list(zip(text.tolist(), begin.tolist(), size.tolist(), zip(one.tolist(), two.tolist(), strict=True), strict=True))
    assert len(found) == len(set(found))
    hashes, total = {}, 0
    for k, t in enumerate(texts):
        words, places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)], {}
        for (a, _), (_, b) in zip(words, words[50:]):
            if b - a < 250:
                places.setdefault(t[a:b], []).append(a)
        wanted = set()
        for window, starts in places.items():  # equal windows that meet are one stretch
            first = last = starts[0]
            for a in starts[1:] + [len(t) + 1000]:
                if a > last + len(window):
                    wanted.add((first, last + len(window) - first, window))
                    first = a
                last = a
        mine = {(a, n): h for i, a, n, h in found if i == k}
        total += len(wanted)
        assert sorted((a, n) for i, a, n, _ in found if i == k) == sorted((a, n) for a, n, _ in wanted)
        for a, n, window in wanted:
            if n == len(window):
                assert hashes.setdefault(window, mine[a, n]) == mine[a, n]
    assert len(set(hashes.values())) == len(hashes) and total > 500


def test_passages_of_short_words_go(spark):
    """Passages of 51 and of 55 words in 152 and 164 bytes are found; one of 50 words is not a passage."""
    rng = np.random.default_rng(10)
    words = lambda n, least=2, most=2: " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(least, most + 1)))) for _ in range(n))
    shared = {n: words(n) for n in (50, 51, 55)}
    texts, number = [], 0
    for n, passage in shared.items():
        for _ in range(2):
            texts.append((number, f"{words(30, 6, 9)}X {passage} Y{words(30, 6, 9)}"))
            number += 1
    texts += [(6, shared[55]), (7, shared[51] + "."), (8, "aa " * 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    counts = {r["doc_id"]: r["n_passages"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert counts == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0}
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_passages_from_texts(docs).collect()}
    assert left[0] == texts[0][1] and left[8] == texts[8][1] and 6 not in left and left[7] == texts[7][1]
    assert all(shared[n] not in left[i] and "X" in left[i] and "Y" in left[i] for i, n in ((2, 51), (3, 51), (4, 55), (5, 55)))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 800, 0])
def test_passages_match_plain_loops(edges, edge_rows, hot):
    rows = [(i, (t or "").encode()) for i, t in edge_rows]
    wanted = passages(rows)
    found = suffix_dedup.remove_repeats(edges, hot).select("doc_id", "n_bytes", "n_passages").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, len(t), len(w))) for (i, t), w in zip(rows, wanted, strict=True))
    assert sum(map(len, wanted)) > 5
