"""Mixing sources to target weights: soft domain membership and nonnegative document rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytestream import in_chunks, joined, word_bounds
from .common import stored

#: Labelled texts per domain that the classifier is fitted on, at most about so many.
SAMPLE_PER_DOMAIN = 400
BINS = 2048
EPOCHS, RATE, DECAY = 120, 40.0, 1e-4
#: Bytes that a task turns into histograms at a time.
CHUNK = 2_000_000
#: Shares of a full step, and multiples of a plain one, that are tried in one pass.
LENGTHS, MULTIPLES = (1.0, 0.5, 0.2), (1.0, 3.0, 10.0, 40.0)
#: Labels up to which the sample has its full rows a label, and rows a label with more of them.
MANY_LABELS, LEAST_PER_LABEL = 64, 25


def histograms(texts: list[bytes]) -> np.ndarray:
    """Square roots of the relative frequencies of the byte pairs of every text, in BINS hashed bins."""
    data, offsets = joined(texts)
    out = np.zeros((len(texts), BINS), np.float32)
    if data.size < 2:
        return out
    pairs = data[:-1].astype(np.uint32) * np.uint32(256) + data[1:]
    bins = ((pairs * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[:-1]
    whole = np.ones(data.size - 1, bool)  # pairs across two texts don't count
    cuts = offsets[1:-1] - 1
    whole[cuts[(cuts >= 0) & (cuts < whole.size)]] = False
    counts = np.bincount((owner * BINS + bins)[whole], minlength=len(texts) * BINS).reshape(len(texts), BINS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class DomainModel:
    """Linear softmax classifier over byte-pair histograms."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        return softmax(histograms(texts) @ self.weights + self.bias)


def sample_labelled(labelled: DataFrame, label: str, per_label: int, seed: int) -> DataFrame:
    """About ``per_label`` rows of each label (all, if fewer), chosen by a hash of doc_id and text length.

    Every label is drawn from. With over MANY_LABELS of them the rows of each are fewer, LEAST_PER_LABEL or more.
    """
    counts = labelled.groupBy(label).count().collect()
    per_label = min(per_label, max(LEAST_PER_LABEL, per_label * MANY_LABELS // max(len(counts), 1)))
    rates = [(row[label], min(1.0, per_label / row["count"])) for row in counts]
    drawn = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    known = labelled.sparkSession.createDataFrame(rates, T.StructType([labelled.schema[label], T.StructField("_rate", T.DoubleType())]))
    return labelled.join(F.broadcast(known), label).where(drawn < F.col("_rate")).select(*labelled.columns)


def fit_domains(labelled: DataFrame, label: str, per_label: int = SAMPLE_PER_DOMAIN, seed: int = 3) -> DomainModel:
    """Fit the classifier on a bounded sample of (text, label); histograms, not texts, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label")
            for start, end in in_chunks(texts, CHUNK):
                values = [x.tobytes() for x in histograms(texts[start:end])]
                yield pa.RecordBatch.from_arrays([labels[start:end], pa.array(values, pa.binary())], ["label", "x"])

    known = labelled.where(F.col(label).isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 1))
    sample = sample_labelled(known, label, per_label, seed)
    rows = sample.select(F.col(label).alias("label"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "label string, x binary"
    )
    found = sorted((r["label"], bytes(r["x"])) for r in rows.collect())
    domains = tuple(sorted({label for label, _ in found}))
    if not domains:
        return DomainModel(("",), np.zeros((BINS, 1), np.float32), np.zeros(1, np.float32))
    x = np.stack([np.frombuffer(v, np.float32) for _, v in found])
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(label) for label, _ in found]]
    weights, bias = np.zeros((BINS, len(domains)), np.float32), np.zeros(len(domains), np.float32)
    for _ in range(EPOCHS):
        error = (y - softmax(x @ weights + bias)) / len(x)
        weights += RATE * (x.T @ error - DECAY * weights)
        bias += error.sum(axis=0)
    return DomainModel(domains, weights, bias)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, the crc32 of the text, its tokens (words) and the posterior of every domain."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for start, end in in_chunks(texts, CHUNK):
                data, offsets = joined(texts[start:end])
                words = np.diff(word_bounds(data, offsets)[2])
                p = shared.value.posteriors(texts[start:end]).astype(np.float64)
                columns = [c[start:end] for c in (batch.column("doc_id"), batch.column("crc"))]
                columns += [pa.array(words, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "crc", "n_tokens", "posterior"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.crc32(text).alias("crc"), text.alias("text")).mapInArrow(
        run, "doc_id long, crc long, n_tokens long, posterior array<double>"
    )


def smoothed_targets(totals: list[float], temperature: float, headroom: float) -> list[float]:
    """Token totals with shares ``share ** temperature``, so large that no domain must shrink."""
    weights = [max(t, 0.0) ** temperature for t in totals]
    scale = headroom * max((t / w for t, w in zip(totals, weights, strict=True) if w > 0), default=0.0)
    return [w * scale for w in weights]


Steps = list[tuple[list[float], list[float]]]  # move and gap of each


def moved(rate: np.ndarray, posterior: np.ndarray, move: np.ndarray, gap: np.ndarray, least: float) -> np.ndarray:
    """One projected step: documents at the bound that the gap pushes against it stay, the others move and are held."""
    free = (rate > least) | (posterior @ gap > 0)
    return np.where(free, np.maximum(least, rate + posterior @ move), rate)


def rates(posterior: np.ndarray, steps: Steps, least: float) -> np.ndarray:
    """The rates of documents after all steps, from 1."""
    out = np.ones(len(posterior))
    for move, gap in steps:
        out = moved(out, posterior, np.array(move), np.array(gap), least)
    return out


def matrices(batch: pa.RecordBatch, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and posteriors of the documents of a batch."""
    flat = batch.column("posterior").flatten().to_numpy(zero_copy_only=False)
    return batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64), flat.reshape(batch.num_rows, domains)


def summed(members: DataFrame, shape: tuple[int, ...], domains: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all documents of an array of ``shape``, which ``part`` gives for the tokens and posteriors of some.

    A task adds up its own documents and hands on the numbers of one array, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(*matrices(batch, domains))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total.reshape(-1)[place])], ["place", "value"])

    rows = members.select("n_tokens", "posterior").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(shape)
    for r in rows:
        out.reshape(-1)[r["place"]] = r["value"]
    return out


def fit_rates(
    members: DataFrame, domains: int, weights: list[float] | None, least: float, temperature: float = 0.7,
    headroom: float = 1.02, iterations: int = 40, tolerance: float = 1e-6,
) -> tuple[Steps, list[float], list[float]]:
    """Projected gradient on the squared gap between expected and target domain totals.

    The variables are one rate a document, which follows from its posterior and the steps so far; a pass sums
    rate * tokens * posterior by domain, one array a task. The gradient is scaled by the documents' tokens and by the
    Gram matrix of the documents that are free to move, so that a step without a bound in its way is exact; of several
    lengths of that step, and of the plain one, which always lessens the gap, the best is taken. A fixed point is a least
    squares solution: no free document can lessen the gap, and those at the bound could only by going under it. Returns
    the steps, the targets and the last totals.
    """
    totals = summed(members, (domains,), domains, lambda tokens, p: tokens @ p)
    if weights is None:
        targets = smoothed_targets(totals.tolist(), temperature, headroom)
    else:
        scale = headroom * max((t / w for t, w in zip(totals, weights, strict=True) if w > 0), default=0.0)
        targets = [w * scale for w in weights]
    steps: Steps = []

    def gram_of(tokens: np.ndarray, p: np.ndarray, gap: np.ndarray) -> np.ndarray:
        free = (rates(p, steps, least) > least) | (p @ gap > 0)
        return (p[free] * tokens[free, None]).T @ p[free]

    def tried(tokens: np.ndarray, p: np.ndarray, trials: list[np.ndarray], gap: np.ndarray) -> np.ndarray:
        now = rates(p, steps, least)
        return np.stack([(moved(now, p, t, gap, least) * tokens) @ p for t in trials])

    for _ in range(iterations):
        gap = np.array(targets) - totals
        if np.abs(gap).max() <= tolerance * max(sum(targets), 1.0):
            break
        gram = summed(members, (domains, domains), domains, partial(gram_of, gap=gap))
        full, plain = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ gap, gap / max(np.trace(gram), 1e-9)
        trials = [full * share for share in LENGTHS] + [plain * times for times in MULTIPLES]
        reached = summed(members, (len(trials), domains), domains, partial(tried, trials=trials, gap=gap))
        best = int(((np.array(targets) - reached) ** 2).sum(axis=1).argmin())
        if ((np.array(targets) - reached[best]) ** 2).sum() >= (gap**2).sum() * (1 - 1e-9):
            break
        steps.append((trials[best].tolist(), gap.tolist()))
        totals = reached[best]
    return steps, targets, totals.tolist()


def with_rates(members: DataFrame, domains: int, steps: Steps, least: float) -> DataFrame:
    """Add the rate of every document, the place of its likeliest domain and that domain's posterior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = matrices(batch, domains)
            columns = [*batch.columns[:3], pa.array(rates(p, steps, least)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "crc", "n_tokens", "rate", "place", "posterior"])

    rows = members.select("doc_id", "crc", "n_tokens", "posterior")
    return rows.mapInArrow(run, "doc_id long, crc long, n_tokens long, rate double, place int, posterior double")


def mix_sources(
    docs: DataFrame, label: str = "lang", weights: dict[str, float] | None = None, least: float = 0.0, seed: int = 17
) -> DataFrame:
    """Rate every document so that the expected tokens of each domain match the target weights.

    Domains are all values of ``label``; a classifier fitted on a bounded labelled sample
    gives every document its posteriors. Without ``weights`` the targets are temperature-smoothed shares. Returns
    doc_id, n_tokens, domain (likeliest), posterior, rate and copies: the whole part of the rate plus one with the
    probability of its fraction, drawn by a hash of (doc_id, crc32 of the text, seed). A null or empty text has no
    tokens and changes no total; without labels there is one domain named ''. Repeated rows get equal results.
    """
    model = fit_domains(docs.select("doc_id", "text", label), label)
    members = stored(with_posteriors(docs, model))
    wanted = None if weights is None else [float(weights.get(d, 0.0)) for d in model.domains]
    steps, _, _ = fit_rates(members, len(model.domains), wanted, least)
    domains = dict(enumerate(model.domains))
    names = F.element_at(F.create_map(*[F.lit(x) for pair in domains.items() for x in pair]), F.col("place"))
    drawn = F.pmod(F.xxhash64("doc_id", "crc", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    rated = with_rates(members, len(domains), steps, least)
    return rated.select(
        "doc_id",
        "crc",
        "n_tokens",
        names.alias("domain"),
        F.round("posterior", 6).alias("posterior"),
        F.round("rate", 6).alias("rate"),
        (F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"),
    )
