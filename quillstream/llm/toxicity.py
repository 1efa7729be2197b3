"""Toxicity by weak supervision: many lexicon and pattern voters, a label model, and a linear classifier."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored
from .mixing import sample_labelled

#: Labelled rows of each class that voters, label model and classifier are fitted on, at most about so many.
SAMPLE_PER_CLASS = 4000
#: Candidate word beginnings that reach the driver, voters made of them, and what a candidate must reach.
CANDIDATES, MINED, PREFIXES, LEAST_ROWS, LEAST_PRECISION = 3000, 64, (4, 5, 6), 4, 0.9
#: Insult stems for the lexicon voters, by language.
LEXICON = {
    "en": "idiot moron stupid scum trash loser clown pathetic worthless disgusting filth vermin imbecile",
    "de": "idiot dumm abschaum arschloch widerlich wertlos trottel versager ekelhaft dreck",
    "fr": "idiot stupide ordure connard minable imbécile crétin abruti dégoûtant salaud",
    "es": "idiota estúpid imbécil basura escoria patétic asqueros inútil perdedor payaso",
}
#: Pattern voters, with the class they vote for.
PATTERNS = (
    ("address", r"\b(?:you|du|tu|vous|usted|ihr)\b.{0,20}\b(?:are|bist|es|êtes|eres|seid)\b.{0,20}\b(?:idiot|stupid|dumm|imb)", 1),
    ("shouting", r"\b[A-ZÄÖÜÉ]{4,}(?:\s+[A-ZÄÖÜÉ]{4,}){4,}.{0,40}!{2,}", 1),
    ("masked", r"\b\w[*#@$%]{2,}\w+\b", 1),
    ("hate", r"\b(?:hate|hasse|déteste|odio)\s+(?:you|dich|euch|te|vous|them)\b", 1),
)
WORD = re.compile(r"\w+")
FOLDS, HELD_OUT = 5, 0
FOLD_WEIGHT, ROUNDS, EPOCHS = 0.95, 25, 400
#: Pseudo-counts of every pair of votes.
SMOOTHED = 0.05


@dataclass
class ToxicModel:
    """Voters and the linear classifier over their votes."""

    stems: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def compiled(self) -> tuple[re.Pattern | None, list[re.Pattern]]:
        stems = sorted(self.stems, key=lambda s: (-len(s), s))
        found = re.compile(r"\b(?:" + "|".join(map(re.escape, stems)) + ")") if stems else None
        return found, [re.compile(p) for _, p, _ in PATTERNS]


def count_voters(stems: tuple[str, ...]) -> int:
    return len(stems) + len(LEXICON) + len(PATTERNS)


def votes(texts: list[str], stems: tuple[str, ...]) -> np.ndarray:
    """1 where a voter votes toxic, 0 where it abstains: mined stems, lexicons, patterns."""
    model = ToxicModel(tuple(dict.fromkeys([*stems, *" ".join(LEXICON.values()).split()])), np.zeros(0), 0)
    finder, patterns = model.compiled()
    order = {s: i for i, s in enumerate(stems)}
    lexicons = [words.split() for words in LEXICON.values()]
    starts = [(s, i) for s, i in order.items()]
    out = np.zeros((len(texts), count_voters(stems)), np.int8)
    for row, text in enumerate(texts):
        for hit in set(finder.findall(text.lower())):
            for stem, i in starts:  # a longer stem also has its beginnings
                if hit.startswith(stem):
                    out[row, i] = 1
            for k, words in enumerate(lexicons):  # the hit may be a longer mined stem than the lexicon's word
                if any(hit.startswith(w) for w in words):
                    out[row, len(stems) + k] = 1
        for k, pattern in enumerate(patterns):
            out[row, len(stems) + len(LEXICON) + k] = bool(pattern.search(text))
    return out


def beginnings(text: str) -> set[str]:
    """The lower-case words of a text and their first 4, 5 and 6 letters."""
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in PREFIXES if len(w) >= n} | {w for w in words if 3 <= len(w) <= 16}


def mine_stems(sample: DataFrame) -> tuple[str, ...]:
    """Word beginnings that mark toxic rows of the sample, chosen so that each adds rows not marked yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "toxic")), strict=True):
                found = sorted(beginnings(text))
                columns = [pa.array([key] * len(found), pa.int64()), pa.array([toxic] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], ["row", "toxic", "stem"])

    pairs = stored(sample.select("row", "text", "toxic").mapInArrow(run, "row long, toxic int, stem string"))
    counts = pairs.groupBy("stem").agg(F.sum("toxic").alias("hits"), F.count("*").alias("rows"))
    good = counts.where((F.col("hits") >= LEAST_ROWS) & (F.col("hits") >= LEAST_PRECISION * F.col("rows")))
    best = stored(good.orderBy(F.desc("hits"), "stem").limit(CANDIDATES))
    marked = pairs.where("toxic = 1").join(F.broadcast(best.select("stem")), "stem").groupBy("stem")
    members = {r["stem"]: set(r["rows"]) for r in marked.agg(F.collect_set("row").alias("rows")).collect()}
    chosen, covered = [], defaultdict(int)
    while members and len(chosen) < MINED:  # rows count in full until two voters mark them
        stem = max(sorted(members), key=lambda s: (sum(1.0 if not covered[r] else 0.3 if covered[r] == 1 else 0.0 for r in members[s]), -len(s)))
        gain = sum(covered[r] < 2 for r in members[stem])
        if gain < LEAST_ROWS:
            break
        chosen.append(stem)
        for r in members.pop(stem):
            covered[r] += 1
    return tuple(chosen)


def weighted_pairs(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Joint probabilities of every two voters, [voter, voter, vote, vote], among rows of these weights; smoothed."""
    total = weight.sum()
    both = (x * weight[:, None]).T @ x
    one = np.diag(both)
    counts = np.stack([np.stack([total - one[:, None] - one[None] + both, one[None] - both], -1), np.stack([one[:, None] - both, both], -1)], -2)
    out = (np.maximum(counts, 0) + SMOOTHED) / (total + 4 * SMOOTHED)
    for j in range(len(one)):  # a voter with itself
        on = (one[j] + 2 * SMOOTHED) / (total + 4 * SMOOTHED)
        out[j, j] = [[1 - on, 0], [0, on]]
    return out


def dependency_tree(tables: list[np.ndarray], shares: tuple[float, float]) -> list[tuple[int, int]]:
    """(voter, parent) from the root (parent -1) down: the tree of most mutual information given the class."""
    m = len(tables[0])
    information = np.zeros((m, m))
    for table, share in zip(tables, shares, strict=True):
        first, second = table.sum(axis=3)[..., :, None], table.sum(axis=2)[..., None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            information += share * np.nan_to_num(table * np.log(table / (first * second)), posinf=0, neginf=0).sum(axis=(2, 3))
    np.fill_diagonal(information, -np.inf)
    tree, best, parent, waiting = [(0, -1)], information[0].copy(), np.zeros(m, int), np.ones(m, bool)
    waiting[0] = False
    while waiting.any():
        j = int(np.where(waiting, best, -np.inf).argmax())
        tree.append((j, int(parent[j])))
        waiting[j] = False
        nearer = waiting & (information[j] > best)
        best[nearer], parent[nearer] = information[j][nearer], j
    return tree


def tree_evidence(x: np.ndarray, tables: list[np.ndarray], tree: list[tuple[int, int]]) -> np.ndarray:
    """Log likelihood ratio of class 1 over 0 of every row: each voter given its parent's vote."""
    score, votes_of = np.zeros(len(x)), x.astype(int)
    for j, parent in tree:
        ratio = np.zeros((2, 2))
        for sign, table in zip((1, -1), tables, strict=True):
            joint = table[j, j].sum(axis=1)[:, None] * np.array([[1.0, 1.0]]) if parent < 0 else table[j, parent]
            ratio += sign * np.log(joint / joint.sum(axis=0, keepdims=True))
        score += ratio[votes_of[:, j], votes_of[:, parent] if parent >= 0 else 0]
    return score


def label_model(matrix: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Posterior of class 1 for every row of votes, by EM; the given label is one more voter of a set accuracy.

    In each class a voter fires with a probability that depends on the vote of one other voter, its parent. These
    probabilities, which hold the accuracies and the correlations of the voters, and the tree of parents are
    estimated anew in every round; voters that say the same thing count about once, as the second adds nothing given
    the first.
    """
    x = matrix.astype(np.float64)
    given = np.where(labels == 1, FOLD_WEIGHT, 1 - FOLD_WEIGHT)
    posterior = given.copy()
    for _ in range(ROUNDS):
        share = float(np.clip(posterior.mean(), 0.01, 0.99))
        tables = [weighted_pairs(x, posterior), weighted_pairs(x, 1 - posterior)]
        evidence = tree_evidence(x, tables, dependency_tree(tables, (share, 1 - share)))
        score = np.log(share / (1 - share)) + np.log(given / (1 - given)) + evidence
        posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return posterior


def features(matrix: np.ndarray) -> np.ndarray:
    """The votes, whether any voter fired, and whether two or more did."""
    n = matrix.sum(axis=1)
    return np.concatenate([matrix, (n > 0)[:, None], (n > 1)[:, None]], axis=1).astype(np.float64)


def fit(labelled: DataFrame) -> ToxicModel | None:
    """Fit voters, label model and classifier on a bounded sample of labelled rows (row, text, toxic)."""
    sample = stored(sample_labelled(labelled, "toxic", SAMPLE_PER_CLASS, 7).withColumn("row", F.monotonically_increasing_id()))
    stems = mine_stems(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in votes(batch.column("text").to_pylist(), stems)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())], ["toxic", "votes"])

    rows = sample.select("text", "toxic").mapInArrow(run, "toxic int, votes binary").collect()
    if not rows:
        return None
    labels = np.array([r["toxic"] for r in rows])
    matrix = np.stack([np.frombuffer(bytes(r["votes"]), np.int8) for r in rows])
    posterior, x = label_model(matrix, labels), features(matrix)
    weights, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(EPOCHS):
        error = posterior - 1 / (1 + np.exp(-(x @ weights + bias)))
        weights += 1.0 * (x.T @ error / len(x) * 4 - 1e-3 * weights)
        bias += 4.0 * error.mean()
    return ToxicModel(stems, weights, float(bias))


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """Score every whole text; ``keep`` carries all columns of ``docs`` along.

    Labels are learned from rows outside the held-out fold (crc32 of doc_id mod 5 = 0) with a label of 0 or 1 and a
    text; of rows with one doc_id the least text stands for all. Returns doc_id, held_out, score and predicted. A null text
    counts as empty, which no voter marks; without usable labels every score is 0. Repeated rows get equal scores;
    an empty table gives an empty result; a document with several labels counts as toxic if one says so.
    """
    usable = labels.where("toxic IN (0, 1)").where(fold("doc_id", FOLDS) != HELD_OUT)
    usable = usable.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    slim = docs.select("doc_id", "text").where("text IS NOT NULL")
    drawn = sample_labelled(usable.select(F.col("_labelled").alias("doc_id"), F.lit("").alias("text"), "toxic"), "toxic", SAMPLE_PER_CLASS, 7)
    chosen = drawn.select(F.col("doc_id").alias("_labelled"), "toxic")
    known = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).groupBy("doc_id")
    model = fit(known.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if model is None:
                score = np.zeros(len(texts))
            else:
                score = 1 / (1 + np.exp(-(features(votes(texts, model.stems)) @ model.weights + model.bias)))
            columns = [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            if not keep:
                columns = [batch.column("doc_id"), batch.column("held_out"), *columns[-2:]]
            names = [*batch.schema.names, "score", "predicted"] if keep else ["doc_id", "held_out", "score", "predicted"]
            yield pa.RecordBatch.from_arrays(columns, names)

    held = (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    given = docs.select("*", held) if keep else docs.select(F.col("doc_id").cast("long"), held, "text")
    kept = ", ".join(f"`{c}` {t}" for c, t in given.dtypes) if keep else "doc_id long, held_out boolean"
    return given.mapInArrow(run, f"{kept}, score double, predicted int")
