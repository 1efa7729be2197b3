"""Language identification: a byte convolutional network trained in numpy, applied to windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestream import in_chunks, joined
from .common import fold
from .mixing import sample_labelled, softmax

#: Labelled texts per language that the network is trained on, at most about so many; one window of each.
SAMPLE_PER_LANGUAGE = 1500
#: Filter widths and filters of each width; bytes of a window, and the step that loses no filter position.
WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
STEP = WINDOW - max(WIDTHS) + 1
EPOCHS, BATCH, LEARNING = 8, 64, 0.02
#: Windows that meet in one matrix, and bytes that a task holds at a time.
ROWS, CHUNK = 1024, 2_000_000
PAD = 0x20
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
HELD_OUT, FOLDS = 2, 4


@dataclass
class Network:
    """Filters over one-hot bytes (a table a filter offset), max pooling over positions, softmax."""

    languages: tuple[str, ...]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For every width a table over byte pairs for its first two offsets, and one for the other one or two."""
        found = []
        for width in WIDTHS:
            t = self.tables[width]
            head = (t[0][:, None] + t[1][None] + self.biases[width]).reshape(65536, FILTERS)
            rest = None if width == 2 else t[2] if width == 3 else (t[2][:, None] + t[3][None]).reshape(65536, FILTERS)
            found.append((np.ascontiguousarray(head), None if rest is None else np.ascontiguousarray(rest)))
        return found

    def probabilities(self, windows: np.ndarray, tables: list) -> np.ndarray:
        two = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for width, (head, rest) in zip(WIDTHS, tables, strict=True):
            length = WINDOW - width + 1
            x = head[two[:, :length]]
            if width == 3:
                x += rest[windows[:, 2:]]
            elif width == 4:
                x += rest[two[:, 2:]]
            pooled.append(np.maximum(x.max(axis=1), 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of every text (at least one each), the text of each window and its bytes in use."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-(lengths - (WINDOW - STEP)) // STEP))
    owner = np.repeat(np.arange(lengths.size), counts)
    number = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, used = offsets[:-1][owner] + number * STEP, np.clip(lengths[owner] - number * STEP, 0, WINDOW)
    padded = np.concatenate([data, np.full(WINDOW, PAD, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]
    windows[np.arange(WINDOW) >= used[:, None]] = PAD
    return windows, owner, used


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int = 4) -> Network:
    """Adam on the cross entropy; a pooled value passes its gradient to the position that it came from."""
    rng = np.random.default_rng(seed)
    params = {f"t{w}": rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS}
    params |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
    params |= {"o": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))), "c": np.zeros(len(languages))}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    target, step = np.eye(len(languages))[labels], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]].astype(np.int64), target[order[at : at + BATCH]]
            pooled, best = [], {}
            for w in WIDTHS:
                length = WINDOW - w + 1
                z = sum(params[f"t{w}"][j][x[:, j : j + length]] for j in range(w)) + params[f"b{w}"]
                best[w] = z.argmax(axis=1)
                pooled.append(np.take_along_axis(z, best[w][:, None], 1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            error = (softmax(hidden @ params["o"] + params["c"]) - y) / len(x)
            back = (error @ params["o"].T) * (raw > 0)
            grads = {"o": hidden.T @ error, "c": error.sum(axis=0)}
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[f"b{w}"], grads[f"t{w}"] = g.sum(axis=0), np.zeros_like(params[f"t{w}"])
                for j in range(w):
                    seen = np.take_along_axis(x, best[w] + j, 1)
                    np.add.at(grads[f"t{w}"][j], (seen, np.arange(FILTERS)[None, :]), g)
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= LEARNING * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    f = np.float32
    return Network(
        languages,
        {w: params[f"t{w}"].astype(f) for w in WIDTHS},
        {w: params[f"b{w}"].astype(f) for w in WIDTHS},
        params["o"].astype(f),
        params["c"].astype(f),
    )


def fit_network(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Train on one window, at a hashed place, of each text of a bounded sample of rows with a language."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    sample = sample_labelled(known, "lang", per_language, 4)
    spare = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit(11)), spare).cast("int") + 1
    rows = sample.select("lang", F.substr("text", start, F.lit(WINDOW)).alias("w")).collect()
    rows = sorted((r["lang"], r["w"].encode()[:WINDOW]) for r in rows)
    if not rows:
        return None
    languages = tuple(sorted({lang for lang, _ in rows}))
    data = np.frombuffer(b"".join(w.ljust(WINDOW, bytes([PAD])) for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return train(data, np.array([languages.index(lang) for lang, _ in rows]), languages)


def predict(texts: list[bytes], network: Network, tables: list) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest language (index) of every text and its probability, averaged over windows by bytes in use."""
    data, offsets = joined(texts)
    windows, owner, used = cut_windows(data, offsets)
    sums = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(windows), ROWS):
        part = slice(at, at + ROWS)
        weighted = network.probabilities(windows[part], tables) * np.maximum(used[part], 1)[:, None]
        np.add.at(sums, owner[part], weighted)
    sums /= sums.sum(axis=1, keepdims=True)
    return sums.argmax(axis=1), sums.max(axis=1)


def identify(docs: DataFrame) -> DataFrame:
    """Predict the language of every whole text.

    Trained on texts and languages outside the held-out fold (crc32 of doc_id mod 4 = 2). Returns doc_id, held_out,
    lang_pred and score. A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
    could be learned. A null id counts as the empty text in the fold; repeated rows get equal results; ties go to
    the language first in order; an empty table gives an empty result; extra columns are ignored.
    """
    network = fit_network(docs.select("doc_id", "text", "lang").where(fold("doc_id", FOLDS) != HELD_OUT))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.pairs() if net else []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            raw = [(t or "").encode() for t in texts]
            for start, end in in_chunks(raw, CHUNK):
                lettered = [t is not None and net is not None and bool(LETTER.search(t)) for t in texts[start:end]]
                lang, score = predict(raw[start:end], net, tables) if net else ([0] * (end - start), [0.0] * (end - start))
                names = [net.languages[k] if ok else UNDETERMINED for k, ok in zip(lang, lettered, strict=True)]
                values = [min(1.0, float(s)) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]
                columns = [batch.column(c)[start:end] for c in ("doc_id", "held_out")]
                columns += [pa.array(names, pa.string()), pa.array(values, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(
        F.col("doc_id").cast("long"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text"
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
