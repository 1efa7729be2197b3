"""Hashes of word shingles of many texts at once, and minimum-hash sketches of the shingle sets."""

from __future__ import annotations

import numpy as np

from .bytestream import joined, word_bounds

WORDS = 5
COORDINATES = 64

_rng = np.random.default_rng(20240501)
_ODD = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _PLACES = _rng.integers(0, 2**63, 256, dtype=np.uint64), _ODD(WORDS)
_XOR, _TIMES = _ODD(COORDINATES), _ODD(COORDINATES)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every word, from one running sum over all bytes."""
    if not data.size:
        return np.zeros(0, np.uint64)
    down = np.full(data.size, _INVERSE)
    down[0] = 1
    np.cumprod(down, out=down)
    up = np.full(data.size + 1, _BASE)
    up[0] = 1
    np.cumprod(up, out=up)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTES[data] * down, out=total[1:])
    return mixed((total[ends] - total[starts]) * up[ends] + (ends - starts).astype(np.uint64))


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and where each text's begin (one more): a text of fewer words has one."""
    data, offsets = joined(texts)
    starts, ends, before = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(before)
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    first = np.repeat(before[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    last = np.repeat(before[1:], n)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    out = np.zeros(bounds[-1], np.uint64)
    for k in range(words):
        out += np.where(first + k < last, padded[first + k], np.uint64(k)) * _PLACES[k % WORDS]
    return mixed(out), bounds


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every text the least of each of COORDINATES hash functions over its shingles; zeros without any."""
    out = np.zeros((bounds.size - 1, COORDINATES), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if some.size:
        for c in range(COORDINATES):
            values = ((hashes ^ _XOR[c]) * _TIMES[c]) >> np.uint64(32)
            out[some, c] = np.minimum.reduceat(values, bounds[:-1][some])
    return out
