"""Byte-level BPE: padded id matrices in which each row merges its least pair every round, and the way back to bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix of pieces of like length; a longer piece is a matrix of its own.
CELLS = 400_000
#: Texts are split this many characters at a time, and encoded pieces of up to so many characters kept, up to this number, in a worker.
CHUNK_CHARS, CACHED_CHARS, CACHED_PIECES = 1_500_000, 256, 250_000
NO_RANK = np.int32(2**31 - 1)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    return [ranked[i] for i in range(len(ranked))]


class Vocabulary:
    """Hashed table of mergeable pairs, and the bytes of every id."""

    def __init__(self, tokens: list[bytes]) -> None:
        ranks = {token: i for i, token in enumerate(tokens)}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bits = max(10, (4 * len(pairs) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self._slot(keys)
        while keys.size:  # of those that want the same free slot one gets it, the others move on
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of each pair's merge; NO_RANK where the pair does not merge or an id is negative."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        while todo.size:
            seen, wanted = self.keys[at], keys[todo]
            hit = seen == wanted
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (seen != -1)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def next_ranks(self, ids: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places of the matrix."""
        right = np.where(at + 1 < ids.shape[1], ids[row, np.minimum(at + 1, ids.shape[1] - 1)], np.int32(-1))
        return self.merged(ids[row, at], right)

    def merge(self, ids: np.ndarray, ranks: np.ndarray, best: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge the marked pairs, of rank ``best`` in each row, and close the gaps; and the least rank that is new."""
        n, width = ids.shape
        keep = ids >= 0
        keep[:, 1:] &= ~mark[:, :-1]
        place = np.cumsum(keep, axis=1) - 1
        row, at = np.nonzero(keep)
        used = int(place[:, -1].max(initial=0)) + 1
        out, new = np.full((n, used), -1, np.int32), np.full((n, used), NO_RANK, np.int32)
        out[row, place[row, at]] = np.where(mark[row, at], best[row], ids[row, at])
        new[row, place[row, at]] = ranks[row, at]
        row, at = np.nonzero(mark)
        at = place[row, at]
        ahead = at > 0
        both, begin = np.concatenate([row, row[ahead]]), np.concatenate([at, at[ahead] - 1])
        new[both, begin] = self.next_ranks(out, both, begin)
        least = np.full(n, NO_RANK, np.int32)
        np.minimum.at(least, both, new[both, begin])
        return out, new, least

    def encode_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of a similar length: each round, every row merges its pair of least rank, leftmost first.

        All places of that pair are merged at once, as one after the other would be, unless a merge brings forth a pair of
        lower rank, which would have to come before the others; then the row merges the leftmost place only. So a long
        piece takes no more rounds than it has different merges, and any length goes the same way.
        """
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[flat], np.int32(-1)).astype(np.int32)
        ranks = np.full((len(pieces), width), NO_RANK, np.int32)
        ranks[:, :-1] = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rows, done = np.arange(len(pieces)), [None] * len(pieces)
        while True:
            best = ranks.min(axis=1)
            over = best == NO_RANK
            for row, line in zip(rows[over], ids[over], strict=True):  # finished rows leave the matrix
                done[row] = line[line >= 0]
            rows, ids, ranks, best = rows[~over], ids[~over], ranks[~over], best[~over]
            if not rows.size:
                return done
            first = ranks.argmin(axis=1)
            mark = ranks == best[:, None]
            if mark.sum() > rows.size:
                mark = alternating(mark)
                row, at = np.nonzero(mark)
                after = at + 2 < ids.shape[1]  # a merged pair before one that is not merged yet
                row, at = row[after], at[after]
                lower = np.zeros(rows.size, bool)
                lower[row[self.merged(best[row], ids[row, at + 2]) < best[row]]] = True
                made = self.merge(ids, ranks, best, mark)
                lower |= made[2] < best
                if lower.any():
                    mark[lower] = np.arange(ids.shape[1]) == first[lower, None]
                    made = self.merge(ids, ranks, best, mark)
            else:
                made = self.merge(ids, ranks, best, mark)
            ids, ranks, _ = made

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece; the pieces meet in matrices of like lengths."""
        out: list = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece:
                buckets.setdefault(len(piece) if len(piece) <= 16 else -(-len(piece) // 16) * 16, []).append(i)
        for width, members in buckets.items():
            step = max(1, min(CELLS // width, len(members)))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self.encode_matrix([pieces[j] for j in part]), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not ids.size:
            return b""
        lengths = self.lengths[ids]
        first = np.cumsum(lengths) - lengths
        return self.data[np.arange(lengths.sum()) + np.repeat(self.starts[ids] - first, lengths)].tobytes()


def alternating(mark: np.ndarray) -> np.ndarray:
    """Of marks next to each other in a row the first, third and so on: merges from the left that don't overlap."""
    columns = np.arange(mark.shape[1])
    begun = np.maximum.accumulate(np.where(mark & ~np.pad(mark[:, :-1], ((0, 0), (1, 0))), columns, -1), axis=1)
    return mark & ((columns - begun) % 2 == 0)


@lru_cache(maxsize=2)
def _vocabulary(tokens: tuple[bytes, ...]) -> Vocabulary:
    return Vocabulary(list(tokens))


class Encoder:
    """Splits texts, encodes the pieces not seen lately, and joins the ids of each text."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.known: dict[str, tuple[str, bytes]] = {}

    def texts(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """For every text its ids as decimals joined by commas, and as an array."""
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces} - self.known.keys())
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known = {}
            new = list({p for pieces in split for p in pieces})
        long = {}
        for piece, ids in zip(new, self.vocabulary.encode([p.encode() for p in new]), strict=True):
            keep = self.known if len(piece) <= CACHED_CHARS else long
            keep[piece] = (",".join(map(str, ids.tolist())), ids.tobytes())
        known = self.known if not long else {**self.known, **long}
        for pieces in split:
            found = [known[p] for p in pieces]
            yield ",".join([x[0] for x in found]), np.frombuffer(b"".join([x[1] for x in found]), np.int32)


def encode_documents(docs: DataFrame, tokens: list[bytes], pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded
    bytes) and, if asked for, ids. Null and empty texts have no tokens; repeated rows give repeated results; an
    empty table gives an empty result; extra columns are ignored. No shuffle: the vocabulary, of a fixed size,
    is broadcast, and a worker holds the pieces of CHUNK_CHARS characters (of a longer text all of them) and
    CACHED_PIECES encoded ones, each of CACHED_CHARS or fewer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tokens))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(shared.value), pattern)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            rows, start = [], 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= CHUNK_CHARS):
                    chars += len(texts[end])
                    end += 1
                for joined, ids in encoder.texts(texts[start:end]):
                    decoded = encoder.vocabulary.decode(ids)
                    row = (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append((*row, ids) if with_ids else row)
                start = end
            counts, encoded, decoded_again, *ids = zip(*rows, strict=True) if rows else [[]] * (3 + with_ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string())]
            columns.append(pa.array(decoded_again, pa.string()))
            if with_ids:
                columns.append(pa.array(ids[0], pa.list_(pa.int32())))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
