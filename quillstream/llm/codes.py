"""Vector codes: product quantisation in whole numbers, each part assigned by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Scale of the components, parts of a vector, entries of a codebook and rounds of refinement.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are searched for together, and labels up to which their sums are sent to all tasks.
TOGETHER, BROADCAST_ROWS = 8_192, 50_000
LARGEST = 2**63 - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers of a type in which four squared distances can't overflow: 64 bits if they fit, else Python's."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return values if values.shape[-1] * 16 * most * most <= LARGEST else values.astype(object)


class Codebook:
    """Entries of one part, and for each entry all others by distance from it, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squared(entries[:, None, :], entries[None, :, :])
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)
        plain = entries.astype(np.float64)
        self.first = int(np.argmin(squared(plain, plain.mean(axis=0))))  # the middle one, from which every search starts

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower index) and squared distance of every row, by Orchard's search.

        All rows walk in lockstep. A row reads the list of its best entry so far, nearest first. An entry that it
        has not visited is measured; a better one becomes the best, and the row goes on in that one's list. It
        stops when the next entry is more than twice as far from the best entry as the row is: by the triangle
        inequality no later one can be nearer, or as near.
        """
        n, k = len(points), len(self.entries)
        best = np.full(n, self.first)
        gap = squared(points, self.entries[best])
        seen = np.zeros((n, k), bool)
        seen[:, self.first] = True
        place, active = np.zeros(n, np.int64), np.arange(n)
        while active.size:
            active = active[place[active] < k]
            active = active[(self.apart[best[active], place[active]] <= 4 * gap[active]).astype(bool)]
            other = self.near[best[active], place[active]]
            place[active] += 1
            fresh = ~seen[active, other]
            rows, other = active[fresh], other[fresh]
            seen[rows, other] = True
            distance = squared(points[rows], self.entries[other])
            better = (distance < gap[rows]) | ((distance == gap[rows]) & (other < best[rows]))
            rows = rows[better.astype(bool)]
            best[rows], gap[rows], place[rows] = other[better.astype(bool)], distance[better.astype(bool)], 0
        return best, gap


def codebooks(entries: np.ndarray) -> list[Codebook]:
    """From an array of (part, entry, component)."""
    return [Codebook(part) for part in entries]


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers as a matrix of ``width`` columns, zeros after the end of shorter ones."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the vector in whole numbers (v) of the rows whose vectors have finite components only."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return kept.select(F.col("vec_id").cast("long"), F.col("label"), whole.alias("v"))


def first_entries(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows with the least ids (null ids last, ties by vector) as (part, entry, component)."""
    chosen = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    matrix = padded(pa.array([r["v"] for r in chosen], pa.list_(pa.int64())), width)
    return matrix.reshape(len(chosen), parts, width // parts).transpose(1, 0, 2).copy()


def in_batches(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, with their parts as an array of (part, row, component)."""
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(start, TOGETHER)
            yield some, exact(padded(some.column("v"), width).reshape(some.num_rows, parts, -1)).transpose(1, 0, 2)


def refined(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every entry to the floored mean of its parts.

    Tasks add up their own rows, so a row for each component of each entry and task is all that is shuffled, and one
    for each component of each entry is all that the driver gets. An entry that no part chose stays.
    """
    parts, k, size = entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codebooks(exact(shared.value))
        sums, counts = np.zeros((parts, k, size), object), np.zeros((parts, k), np.int64)
        for _, points in in_batches(batches, parts * size, parts):
            for p, book in enumerate(books):
                found, _ = book.assign(points[p])
                counts[p] += np.bincount(found, minlength=k)
                for e in np.unique(found).tolist():
                    # of 64 bits each half is summed by itself, as a sum of many rows may not fit
                    mine = points[p][found == e].astype(np.int64)
                    sums[p, e] += (mine >> 32).sum(axis=0).astype(object) * 2**32 + (mine & 0xFFFFFFFF).sum(axis=0).astype(object)
        p, e, c = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, sums.shape))
        totals = pa.array([str(x) for x in sums[p, e, c]], pa.string())
        columns = [pa.array(((p * k + e) * size + c).astype(np.int64)), totals, pa.array(counts[p, e])]
        yield pa.RecordBatch.from_arrays(columns, ["place", "total", "n"])

    made = rows.select("v").mapInArrow(run, "place long, total string, n long")
    summed = made.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    shared.unpersist()
    out = entries.reshape(-1).copy()
    for r in summed:
        out[r["place"]] = int(r["total"]) // r["n"]
    return out.reshape(entries.shape)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of the vectors, and the codebooks as an array of (part, entry, component).

    The rows are vec_id, label, code (two hex digits a part) and error (squared distances to the entries, summed over
    the parts, at most 2^63 - 1). Rows whose vector is null or has a null or non-finite component go; others stay:
    repeated rows and ids each by themselves, zero vectors, null ids (which come last when the first entries are
    chosen; ties by vector). Components are floored to whole numbers of 1/4096, within 64 bits. A vector shorter than
    the longest, or than a multiple of ``parts``, counts as if zeros followed. With fewer rows than entries every
    row is an entry. An empty table gives no rows and no entries; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    rows = stored(scaled(vectors))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = parts * max(1, -(-(longest or 0) // parts))
    books = first_entries(rows, width, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(rows, books)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = codebooks(exact(shared.value)) if shared.value.shape[1] else []
        for some, points in in_batches(batches, width, parts):
            code, error = np.zeros((some.num_rows, parts), np.uint8), np.zeros(some.num_rows, object)
            for p, book in enumerate(searched):
                code[:, p], gap = book.assign(points[p])
                error = error + gap
            errors = pa.array([min(int(x), LARGEST) for x in error], pa.int64())
            columns = [some.column("vec_id"), some.column("label"), pa.array([x.tobytes().hex() for x in code], pa.string()), errors]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), books


def digest(books: np.ndarray) -> str:
    """sha256 of the components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Add vector: the entries that the code names, end to end, scaled back."""
    table = [[[float(x) / scale for x in entry] for entry in part] for part in books.tolist()]
    shared = codes.sparkSession.sparkContext.broadcast(table)
    names = codes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[x for p, e in enumerate(bytes.fromhex(c)) for x in shared.value[p][e]] for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*names, "vector"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in codes.dtypes)
    return codes.mapInArrow(run, f"{kinds}, vector array<double>")


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and the codebooks' digest.

    Sums of labels are added up before they are shuffled. Up to BROADCAST_ROWS of them go to all tasks, more of them
    are joined by a shuffle, in which Spark splits a label that holds many rows.
    """
    rows, books = compress(vectors)
    rows = stored(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long")
    sums = stored(rows.groupBy("label").agg(total.alias("label_error"))).withColumnRenamed("label", "_label")
    few = sums.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
