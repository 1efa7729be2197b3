from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import bpe, langid, mixing, quality, toxicity
from quillstream.llm.common import stored
from quillstream.llm.queries import tokenizer

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(PATH)), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_bpe_equals_the_library(texts):
    for text, (joined, ids) in zip(texts, ENCODER.texts(texts), strict=True):
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
        assert joined == ",".join(map(str, ids.tolist()))
        assert ENCODER.vocabulary.decode(ids) == text.encode()


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="aeinrst", min_size=257, max_size=700))
def test_long_pieces_follow_the_same_rule(piece):
    assert ENCODER.vocabulary.encode([piece.encode()])[0].tolist() == TIKTOKEN.encode_ordinary(piece)


def one_by_one(vocabulary: list[bytes], piece: bytes) -> list[int]:
    """The rule as it is stated: the leftmost pair of least rank is merged, again and again."""
    ranks, parts = {t: i for i, t in enumerate(vocabulary)}, [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=2, max_size=5), max_size=12, unique=True), st.lists(st.text(alphabet="abc", max_size=40), min_size=1, max_size=5))
def test_any_vocabulary_whatever_its_order(words, pieces):
    """Ranks that no training would give, where a merge may bring forth a pair of lower rank."""
    vocabulary = [bytes([b]) for b in range(256)] + [w.encode() for w in words]
    encoder = bpe.Vocabulary(vocabulary)
    for piece, ids in zip(pieces, encoder.encode([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == one_by_one(vocabulary, piece.encode())


@pytest.mark.parametrize("piece", ["ab" * 5000, "x" * 10_001, "thequickbrown" * 800, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(10_000))])
def test_a_piece_of_10000_bytes(piece):
    assert ENCODER.vocabulary.encode([piece.encode(), b"the"])[0].tolist() == TIKTOKEN.encode_ordinary(piece)
    (joined, ids), again = list(ENCODER.texts([f"of {piece} of", "the"]))
    assert ids.tolist() == TIKTOKEN.encode_ordinary(f"of {piece} of") and again[1].tolist() == TIKTOKEN.encode_ordinary("the")
    assert piece not in ENCODER.known


def test_bpe_rows(edges, edge_rows, nothing):
    got = bpe.encode_documents(edges, *tokenizer(), with_ids=True).collect()
    wanted = []
    for i, t in edge_rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(wanted, key=key)
    assert bpe.encode_documents(nothing, *tokenizer()).count() == 0


def test_quality_counts_by_hand(spark, nothing):
    text = "a b c d e f g h i a b c d e f g h\n\nline one\nline one\n#$ *"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.filter_quality(docs).collect()}
    r = rows[1]
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (23, 17 + 14 + 3, 3, 1)
    assert r["n_repeat_words"] == 16 and r["base_failed"]
    assert all(rows[k]["n_words"] == 0 and rows[k]["base_failed"] and not rows[k]["kept"] for k in (2, 3))
    assert quality.filter_quality(nothing).count() == 0


def test_quality_tells_good_from_bad(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.filter_quality(docs).drop("quality").join(labels, "doc_id").where("NOT base_failed")
    right = judged.agg(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("length(lang) > 0")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_edges(spark, edges, nothing):
    rows = langid.identify(edges).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 15)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == edges.count()
    assert langid.identify(nothing).count() == 0
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_windows_cover_every_byte():
    data = np.arange(1000, dtype=np.int64).astype(np.uint8)
    windows, owner, used = langid.cut_windows(data, np.array([0, 0, 3, 260, 1000]))
    assert owner.tolist().count(0) == 1 and used[0] == 0
    starts = [w for w, o in zip(range(len(owner)), owner, strict=True) if o == 3]
    covered = set()
    for k, w in enumerate(starts):
        covered |= set(range(k * langid.STEP, k * langid.STEP + used[w]))
    assert covered == set(range(740))


def many_labels(spark, n, each):
    """Documents of ``n`` labels whose texts repeat a word of their own; the last labels are the rarest."""
    rows = [(k * 100 + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 30, f"l{k:03}") for k in range(n) for i in range(each + (k < n - 6))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_models_have_every_label(spark):
    docs, labels = many_labels(spark, 70, 3), {f"l{k:03}" for k in range(70)}
    assert set(langid.fit_network(docs).languages) == labels
    assert set(mixing.fit_domains(docs, "lang").domains) == labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((1, 1), 0) > 0.8 * (counts.get((1, 1), 0) + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) < 0.02 * counts[(0, 0)]


def test_votes_against_plain_loops():
    """A voter of a word beginning fires if a word begins with it, however long the stem that another voter has."""
    texts = ["un idiote ici", "Idiots!", "the scummy one", "an idio", "you are really stupid", "w**d imbécile", "AAAA BBBB CCCC DDDD EEEE x!!", "", "preidiot"]
    for stems in ((), ("idiote", "idio", "scum"), ("stupide", "imb")):
        got = toxicity.votes(texts, stems)
        for row, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            wanted = [any(w.startswith(s) for w in words) for s in stems]
            wanted += [any(w.startswith(s) for w in words for s in listed.split()) for listed in toxicity.LEXICON.values()]
            wanted += [bool(re.search(p, text)) for _, p, _ in toxicity.PATTERNS]
            assert got[row].tolist() == list(map(int, wanted)), (text, stems)


def test_repeated_ids_give_one_labelled_row(spark):
    rows = [(i % 7, f"word{i} good text") for i in range(60)] + [(i % 7 + 10, f"idiot {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 10)) for i in [*range(7), *range(10, 17)]], "doc_id long, toxic int")
    first, again = (sorted(map(tuple, toxicity.score_toxicity(docs.repartition(n), labels).collect())) for n in (2, 5))
    assert len(first) == 120 and [r[:2] for r in first] == [r[:2] for r in again]
    assert [r[2] for r in first] == pytest.approx([r[2] for r in again])


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0), (1, 1), (12, 0), (None, 1), (16, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(edges, labels.limit(0)).collect())
    assert toxicity.score_toxicity(nothing, labels, keep=True).columns[: len(nothing.columns)] == nothing.columns


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = (y & (rng.random(4000) < 0.9)).astype(np.int8)
    noisy = (rng.random(4000) < 0.3).astype(np.int8)
    matrix = np.stack([good, *[noisy] * 6], axis=1)
    posterior = toxicity.label_model(matrix, np.where(rng.random(4000) < 0.95, y, ~y))
    assert ((posterior > 0.5) == y).mean() > 0.95


def plain_evidence(matrix, weights, tree):
    """Log likelihood ratios by loops over rows, from the counts of votes given the parent's vote."""
    out = np.zeros(len(matrix))
    for j, parent in tree:
        for row in range(len(matrix)):
            for sign, w in zip((1, -1), weights, strict=True):
                alike = np.array([parent < 0 or m[parent] == matrix[row][parent] for m in matrix])
                counts = [sum(w[k] for k in range(len(matrix)) if alike[k] and matrix[k][j] == v) for v in (0, 1)]
                extra = toxicity.SMOOTHED * (2 if parent < 0 else 1)
                out[row] += sign * np.log((counts[matrix[row][j]] + extra) / (sum(counts) + 2 * extra))
    return out


def test_label_model_equals_plain_loops():
    rng = np.random.default_rng(4)
    labels = (rng.random(60) < 0.4).astype(int)
    base = (labels & (rng.random(60) < 0.8)).astype(np.int8)
    matrix = np.stack([base, base ^ (rng.random(60) < 0.1), (rng.random(60) < 0.3).astype(np.int8), base & (rng.random(60) < 0.5)], axis=1).astype(np.int8)
    given = np.where(labels == 1, toxicity.FOLD_WEIGHT, 1 - toxicity.FOLD_WEIGHT)
    posterior = given.copy()
    for _ in range(toxicity.ROUNDS):
        share = float(np.clip(posterior.mean(), 0.01, 0.99))
        weights = [posterior, 1 - posterior]
        tree = toxicity.dependency_tree([toxicity.weighted_pairs(matrix.astype(float), w) for w in weights], (share, 1 - share))
        assert sorted(j for j, _ in tree) == [0, 1, 2, 3]
        score = np.log(share / (1 - share)) + np.log(given / (1 - given)) + plain_evidence(matrix, weights, tree)
        posterior = 1 / (1 + np.exp(-score))
    assert toxicity.label_model(matrix, labels) == pytest.approx(posterior, abs=1e-9)


def test_toxicity_ties(spark, edges):
    """Rows that are equal but for their id score alike."""
    labels = spark.createDataFrame([(1, 1), (12, 0), (16, 0), (2, 1)], "doc_id long, toxic int")
    scores = {}
    for r in toxicity.score_toxicity(edges.drop("score"), labels, keep=True).collect():
        scores.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in scores.values())


def plain_rates(x, target, least, steps=20000):
    """Nonnegative least squares by plain projected gradient: the gap that is left."""
    rates = np.ones(len(x))
    size = 1 / np.linalg.norm(x @ x.T, 2)
    for _ in range(steps):
        rates = np.maximum(least, rates - size * (x @ (rates @ x - target)))
    return rates, float(((rates @ x - target) ** 2).sum())


@pytest.mark.parametrize("target, least", [([900.0, 400.0, 700.0], 0.0), ([100.0, 100.0, 100.0], 0.0), ([500.0, 1.0, 1.0], 0.5)])
def test_rates_are_a_least_squares_solution(spark, target, least):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(5, 60, 40), rng.dirichlet([0.4] * 3, 40)
    members = spark.createDataFrame([(i, int(t), q.tolist()) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    scale = max((tokens[:, None] * p).sum(axis=0) / target)
    steps, targets, _ = mixing.fit_rates(members, 3, target, least, headroom=1 / scale)
    assert targets == pytest.approx(target)
    found = mixing.with_rates(members.withColumn("crc", F.lit(0).cast("long")), 3, steps, least).select(F.col("rate").alias("r"), "doc_id").orderBy("doc_id").collect()
    rates = np.array([r["r"] for r in found])
    x = tokens[:, None] * p
    gap = float(((rates @ x - np.array(target)) ** 2).sum())
    assert rates.min() >= least
    assert gap <= plain_rates(x, np.array(target), least)[1] + 1e-3 * sum(t * t for t in target)


def test_network_equals_a_plain_convolution():
    rng = np.random.default_rng(5)
    net = langid.Network(("a", "b", "c"), {w: rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS}, {w: rng.normal(0, 1, langid.FILTERS).astype(np.float32) for w in langid.WIDTHS}, rng.normal(0, 1, (langid.FILTERS * 3, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    windows = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8)
    for window, got in zip(windows, net.probabilities(windows, net.pairs()), strict=True):
        pooled = []
        for w in langid.WIDTHS:
            sums = [sum(net.tables[w][j][window[at + j]].astype(float) for j in range(w)) + net.biases[w] for at in range(langid.WINDOW - w + 1)]
            pooled.append(np.maximum(np.max(sums, axis=0), 0))
        scores = np.concatenate(pooled) @ net.out + net.out_bias
        wanted = np.exp(scores - scores.max())
        assert got == pytest.approx(wanted / wanted.sum(), abs=1e-4)


def test_numbers_and_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² 12 ⅷ_"), (2, "é"), (4, "the cat is on the mat and it was"), (5, "der hund ist auf der matte und")], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") == 5, "de").otherwise("en"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_rates_reach_targets(spark, nothing):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rated = mixing.mix_sources(docs, weights={"en": 1.0, "de": 1.0, "fr": 1.0, "es": 1.0})
    model = mixing.fit_domains(docs, "lang")
    members = mixing.with_posteriors(docs, model).join(rated.select("doc_id", "rate"), "doc_id")
    totals = members.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[d]) for d in range(4)]).first()
    assert max(totals) / min(totals) == pytest.approx(1.0, abs=1e-3)
    assert rated.agg(F.min("rate")).first()[0] >= 0
    kept = mixing.mix_sources(docs, least=1.0)
    assert kept.agg(F.min("copies")).first()[0] >= 1
    assert mixing.mix_sources(nothing).count() == 0


def test_two_hundred_labels_end_to_end(spark):
    """As many domains as labels; the Gram matrix is summed in tasks, and expected totals meet the targets."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(400)]
    rows = [(k * 10 + j, " ".join(rng.choice(words[2 * k : 2 * k + 2], 20 + k % 7)), f"l{k:03d}") for k in range(200) for j in range(4 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = mixing.fit_domains(docs, "lang")
    assert len(model.domains) == 200
    members = stored(mixing.with_posteriors(docs, model))
    steps, targets, totals = mixing.fit_rates(members, 200, None, 1.0)
    before = mixing.summed(members, (200,), 200, lambda tokens, p: tokens @ p)
    assert ((np.array(targets) - totals) ** 2).sum() < 0.2 * ((np.array(targets) - before) ** 2).sum()
    rated = mixing.with_rates(members, 200, steps, 1.0).select("doc_id", "rate").join(members, "doc_id").collect()
    assert sum(r["rate"] * r["n_tokens"] * np.array(r["posterior"]) for r in rated) == pytest.approx(np.array(totals), rel=1e-6, abs=1e-3)
    made = mixing.mix_sources(docs).collect()
    assert len(made) == len(rows) and len({r["domain"] for r in made}) > 150


def test_mixing_edges(edges):
    rows = mixing.mix_sources(edges).collect()
    assert len(rows) == edges.count()
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4, 5, 15))
