"""Suffix array and common-prefix values of a byte string by external induced sorting.

The string is cut at its left-most smaller-type (LMS) positions; a first induction sorts the pieces, which are named;
the string of names is sorted recursively; a second induction sorts all suffixes from the sorted LMS ones. Priority
queues hand out suffix tuples by first symbol and then in order of arrival, so they are kept as one queue for each byte
(or, for names, for each range of names), filled from one end; position and common-prefix value travel together.

Over IN_MEMORY symbols the string, its types, its LMS positions, the names, queues and flags are files in the scratch
folder of the task, read and written in runs of RUN, and the recursion goes on in files; a string of names of up to
IN_MEMORY is the base of the recursion and is sorted in memory by ranks.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Symbols up to which a string is sorted in memory, and suffixes taken from a queue at a time.
IN_MEMORY, RUN = 1 << 24, 1 << 20
FAR = np.int32(2**31 - 1)


class Arrays:
    """Makes arrays in memory or, for large strings, in files that go with the folder.

    The folder is in the executor's own scratch space (SPARK_LOCAL_DIRS), where Spark puts its spills too.
    """

    def __init__(self, large: bool) -> None:
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = tempfile.TemporaryDirectory(dir=local if local and os.path.isdir(local) else None) if large else None
        self.made = 0

    def new(self, size: int, dtype: type) -> np.ndarray:
        if self.folder is None or not size:
            return np.zeros(size, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(size,))

    def path(self) -> Path:
        self.made += 1
        return Path(self.folder.name) / f"{self.made}"

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def runs_of(size: int) -> Iterator[slice]:
    for start in range(0, size, RUN):
        yield slice(start, min(size, start + RUN))


def smaller_types(text: np.ndarray, after: bool = False) -> np.ndarray:
    """True where a suffix is smaller than the next one; of the last symbol's equal run that is ``after``."""
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), text.size - 1)
    rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], after)
    return np.repeat(rising, np.diff(np.concatenate([[-1], ends])))


def typed(text: np.ndarray, n: int, arrays: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the first ``n`` suffixes is smaller than the next, and the LMS positions, run by run."""
    smaller = arrays.new(n, bool)
    following = False
    for where in reversed(list(runs_of(n))):
        end = min(where.stop + 1, n)  # one symbol of the run after, whose type is known
        smaller[where] = smaller_types(np.array(text[where.start : end]), following)[: where.stop - where.start]
        following = bool(smaller[where.start])
    parts = []
    for where in runs_of(n):
        first = max(where.start, 1)
        parts.append(np.flatnonzero(smaller[first : where.stop] & ~smaller[first - 1 : where.stop - 1]) + first)
    lms = arrays.new(sum(p.size for p in parts), np.int64)
    at = 0
    for p in parts:
        lms[at : at + p.size] = p
        at += p.size
    return smaller, lms


def by_symbol(text: np.ndarray, places: np.ndarray, symbols: int, arrays: Arrays) -> np.ndarray:
    """``places`` in order of their symbols, equal ones in the given order, run by run."""
    if places.size <= RUN:
        return places[np.argsort(text[places], kind="stable")]
    starts = arrays.new(symbols + 1, np.int64)
    for where in runs_of(places.size):
        found, counts = np.unique(text[places[where]], return_counts=True)
        starts[found.astype(np.int64) + 1] += counts
    np.cumsum(starts, out=starts)
    out = arrays.new(places.size, np.int64)
    for where in runs_of(places.size):
        some = np.array(places[where])
        some = some[np.argsort(text[some], kind="stable")]
        found, first, counts = np.unique(text[some], return_index=True, return_counts=True)
        out[np.repeat(starts[found.astype(np.int64)] - first, counts) + np.arange(some.size)] = some
        starts[found.astype(np.int64)] += counts
    return out


def pair_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix values of pairs of suffixes, up to ``cap``; ``text`` continues ``cap + 16`` zeros or more past its end."""
    out, todo = np.full(a.size, cap, np.int32), np.arange(a.size)
    words = np.ndarray(text.size - 7, "<u8", text, strides=(1,))  # the eight bytes from every position on
    for depth in range(0, cap, 8):
        differ = words[a + depth] ^ words[b + depth]
        ends = differ != 0
        if ends.any():
            lowest = differ[ends] & (~differ[ends] + np.uint64(1))  # the first bit that differs, a power of two
            out[todo[ends]] = depth + ((np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
            todo, a, b = todo[~ends], a[~ends], b[~ends]
        if not todo.size:
            break
    return np.minimum(out, cap)


def adjacent_prefixes(text: np.ndarray, at: np.ndarray, ordered: np.ndarray, cap: int, arrays: Arrays) -> np.ndarray:
    """Common-prefix values, up to ``cap``, of every suffix of ``ordered`` (in order) with the one before it; first 0.
    ``at`` has the same positions as they stand in the text.

    Where the two suffixes that start one place of the list earlier in the text are neighbours too, at the same
    distance, the value is theirs less that distance, so that of a chain of such pairs only the first is compared.
    Long lists are compared pair by pair, run by run.
    """
    m = ordered.size
    if m > RUN:
        out = arrays.new(m, np.int32)
        for where in runs_of(m - 1):
            out[where.start + 1 : where.stop + 1] = pair_prefixes(text, ordered[where], ordered[where.start + 1 : where.stop + 1], cap)
        return out
    number = np.zeros(text.size, np.int32)
    number[at] = np.arange(m)
    place, before = number[ordered], np.full(m, -1)
    before[place[1:]] = place[:-1]
    gap = np.diff(at, prepend=0)
    follows = np.zeros(m, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (gap[1:] == gap[before[1:]])
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(m)))
    out, known = np.zeros(m, np.int64), 2 * cap
    heads = np.flatnonzero(~follows & (before >= 0))
    out[heads] = pair_prefixes(text, at[heads], at[before[heads]], known)
    rest = np.flatnonzero(follows)
    value = out[head[rest]] - (at[rest] - at[head[rest]])
    unknown = (value <= 0) | ((out[head[rest]] == known) & (value < cap))
    out[rest] = value
    again = rest[unknown]
    out[again] = pair_prefixes(text, at[again], at[before[again]], cap)
    return np.minimum(out, cap)[place].astype(np.int32)


class Induction:
    """Sorts all suffixes of ``text`` from its sorted LMS suffixes, carrying common-prefix values up to ``cap``."""

    def __init__(self, text: np.ndarray, n: int, smaller: np.ndarray, cap: int, arrays: Arrays) -> None:
        self.text, self.n, self.smaller, self.cap = text, n, smaller, cap
        counts = np.zeros((2, 256), np.int64)
        for where in runs_of(n):
            for kind in (0, 1):
                counts[kind] += np.bincount(text[where][smaller[where] == bool(kind)], minlength=256)
        self.bounds = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        self.at = [arrays.new(int(c.sum()), np.int64 if n > FAR else np.int32) for c in counts]
        self.prefix = [arrays.new(int(c.sum()), np.int32) for c in counts]

    def _scan(self, kind: int, position: np.ndarray, prefix: np.ndarray) -> None:
        """Queue the predecessors, of one type, of suffixes in the order of the scan.

        prefix: the common prefix of each with the suffix scanned before it. That of two suffixes queued after one
        another is one more than the least of those in between; ``carry`` has it since the last one of each queue.
        """
        before = np.maximum(position - 1, 0)
        wanted = np.flatnonzero((position > 0) & (self.smaller[before] == bool(kind)))
        byte = self.text[before[wanted]]
        order = np.argsort(byte, kind="stable")
        byte, wanted = byte[order], wanted[order]
        least, carry = np.minimum.accumulate(prefix), self.carry.copy()
        self.carry = np.minimum(self.carry, least[-1])
        cuts = np.concatenate([[0], np.flatnonzero(byte[1:] != byte[:-1]) + 1, [byte.size]]) if byte.size else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            c, own = int(byte[lo]), wanted[lo:hi]
            values = np.empty(own.size, np.int64)
            values[0] = min(carry[c], least[own[0]]) + 1 if self.used[c] else 0
            after = np.minimum.reduceat(prefix, own + 1) if own[-1] + 1 < prefix.size else np.append(np.minimum.reduceat(prefix, own[:-1] + 1) if own.size > 1 else [], FAR)
            values[1:] = after[:-1].astype(np.int64) + 1
            self.carry[c], self.used[c] = after[-1], True
            self._put(kind, c, position[own] - 1, np.minimum(values, self.cap))

    def _put(self, kind: int, c: int, position: np.ndarray, prefix: np.ndarray) -> None:
        size, end = position.size, self.filled[c]
        if kind == 0:  # larger types fill from the front, smaller ones from the back
            where = slice(end, end + size)
            self.at[kind][where], self.prefix[kind][where] = position, prefix
            self.filled[c] += size
        else:
            where = slice(end - size, end)
            self.at[kind][where], self.prefix[kind][where] = position[::-1], prefix[::-1]
            self.filled[c] -= size

    def _runs(self, kind: int, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What a queue has and what it gets meanwhile, in the order of the scan."""
        at = self.bounds[kind][c] if kind == 0 else self.bounds[kind][c + 1]
        while at != self.filled[c]:
            if kind == 0:
                where = slice(at, min(self.filled[c], at + RUN))
                at = where.stop
                yield np.array(self.at[kind][where]), np.array(self.prefix[kind][where])
            else:
                where = slice(max(self.filled[c], at - RUN), at)
                at = where.start
                yield np.array(self.at[kind][where])[::-1], np.array(self.prefix[kind][where])[::-1]

    def _between(self, a: int, b: int, named: bool) -> int:
        return 1 if named else int(pair_prefixes(self.text, np.array([a]), np.array([b]), self.cap)[0])

    def run(self, seeds: np.ndarray, prefixes: np.ndarray | None) -> None:
        """seeds: LMS suffixes by first byte, and in order if their prefixes are given; else each stands for its first
        byte alone."""
        whole = prefixes is not None
        cuts = np.searchsorted(self.text[seeds], np.arange(257)) if seeds.size <= RUN else self._cuts(seeds)
        self.carry, self.used, self.filled = np.full(256, FAR), np.zeros(256, bool), self.bounds[0][:-1].copy()
        last = int(self.text[self.n - 1])
        self._put(0, last, np.array([self.n - 1]), np.array([0]))
        self.used[last] = True
        for c in range(256):
            tail = None
            for position, prefix in self._runs(0, c):
                self._scan(0, position, prefix)
                tail = int(position[-1])
            for start in range(cuts[c], cuts[c + 1], RUN):
                where = slice(start, min(cuts[c + 1], start + RUN))
                prefix = np.array(prefixes[where]) if whole else np.ones(where.stop - start, np.int32)
                if start == cuts[c]:
                    prefix[0] = 0 if tail is None else self._between(tail, int(seeds[start]), not whole)
                self._scan(0, np.array(seeds[where]), prefix)
        self.carry, self.used, self.filled = np.full(256, FAR), np.zeros(256, bool), self.bounds[1][1:].copy()
        self.joints = np.zeros(256, np.int64)
        for c in range(255, -1, -1):
            tail = None
            for position, prefix in self._runs(1, c):
                self._scan(1, position, prefix)
                tail = int(position[-1])
            lo, hi = int(self.bounds[0][c]), int(self.bounds[0][c + 1])
            if tail is not None and hi > lo:
                self.joints[c] = self._between(int(self.at[0][hi - 1]), tail, not whole)
            joint, end = self.joints[c], hi
            while end > lo:  # the prefix of a suffix with the next larger one is stored with that one
                start = max(lo, end - RUN)
                position = np.array(self.at[0][start:end])[::-1]
                above = np.array(self.prefix[0][start + 1 : end])[::-1]
                self._scan(1, position, np.concatenate([[joint], above]).astype(np.int32))
                joint, end = self.prefix[0][start], start

    def _cuts(self, seeds: np.ndarray) -> np.ndarray:
        counts = sum(np.bincount(self.text[seeds[where]], minlength=256) for where in runs_of(seeds.size))
        return np.concatenate([[0], np.cumsum(counts)])

    def ordered(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and prefixes with the suffix before, in ascending order, run by run."""
        for c in range(256):
            lo, hi = int(self.bounds[0][c]), int(self.bounds[0][c + 1])
            for start in range(lo, hi, RUN):
                where = slice(start, min(hi, start + RUN))
                yield np.array(self.at[0][where]), np.array(self.prefix[0][where])
            first, end = int(self.bounds[1][c]), int(self.bounds[1][c + 1])
            for start in range(first, end, RUN):  # stored with the next larger one, so moved on by one place
                stop = min(end, start + RUN)
                before = self.prefix[1][start - 1] if start > first else self.joints[c] if hi > lo else 0
                moved = np.concatenate([[before], self.prefix[1][start : stop - 1]])
                yield np.array(self.at[1][start:stop]), moved.astype(np.int32)


def ranked_order(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a string of names in memory: ranks double the length they look at.

    Only suffixes that still share their rank are sorted again. Suffixes equal over ``most`` names stay as they are.
    """
    n = names.size
    order = np.argsort(names, kind="stable")
    rank = np.zeros(n, np.int64)
    sorted_names = names[order]
    starts = np.flatnonzero(np.append(True, sorted_names[1:] != sorted_names[:-1]))
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    length = 1
    while length < most:
        counts = np.bincount(rank, minlength=n)
        places = np.flatnonzero(counts[rank[order]] > 1)
        if not places.size:
            break
        members = order[places]
        after = np.where(members + length < n, rank[np.minimum(members + length, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + after
        by_key = np.argsort(key, kind="stable")
        members, key = members[by_key], key[by_key]
        order[places] = members
        first = np.append(True, key[1:] != key[:-1])
        rank[members] = places[np.flatnonzero(first)][np.cumsum(first) - 1]
        length *= 2
    return order


class NameInduction:
    """Sorts all suffixes of a long string of names from its LMS suffixes, one queue for each range of names.

    A range has up to RUN suffixes, or one name. Suffixes queued from other ranges come in order of arrival; those
    queued from inside a range follow the order of the suffixes after them, which takes one round a link.
    """

    def __init__(self, names: np.ndarray, smaller: np.ndarray, symbols: int, most: int, arrays: Arrays) -> None:
        self.names, self.smaller, self.most = names, smaller, most
        counts = [arrays.new(symbols + 1, np.int64) for _ in (0, 1)]
        for where in runs_of(names.size):
            kind = smaller[where]
            for k in (0, 1):
                found, n = np.unique(names[where][kind == bool(k)], return_counts=True)
                counts[k][found + 1] += n
        for c in counts:
            np.cumsum(c, out=c)
        self.starts, edges = [0], [0]
        while edges[-1] < symbols:  # the names at which ranges begin
            done = counts[0][edges[-1]] + counts[1][edges[-1]]
            lo, hi = edges[-1] + 1, symbols
            while lo < hi:  # the last one that keeps the range within RUN
                middle = (lo + hi + 1) // 2
                if counts[0][middle] + counts[1][middle] - done <= RUN:
                    lo = middle
                else:
                    hi = middle - 1
            edges.append(lo)
        self.edges = np.array(edges)
        self.bounds = [np.array(c[self.edges]) for c in counts]
        self.at = [arrays.new(int(c[-1]), np.int64) for c in counts]

    def _queue(self, kind: int, scanned: np.ndarray, done: int) -> None:
        """Queue the predecessors of one type of scanned suffixes, but those in range ``done``."""
        before = scanned[scanned > 0] - 1
        before = before[self.smaller[before] == bool(kind)]
        ranges = np.searchsorted(self.edges, self.names[before], "right") - 1
        order = np.argsort(ranges, kind="stable")
        before, ranges = before[order], ranges[order]
        for lo, hi in zip(*_cuts(ranges), strict=True):
            r = int(ranges[lo])
            if r != done:
                self.at[kind][self.filled[r] : self.filled[r] + hi - lo] = before[lo:hi]
                self.filled[r] += hi - lo

    def _arranged(self, kind: int, r: int, fixed: np.ndarray, sign: int) -> np.ndarray:
        """All suffixes of a small range in the order of the scan; those of the type are stored in that order."""
        arrived = np.array(self.at[kind][self.bounds[kind][r] : self.filled[r]])
        rows, parents, frontier, first = [arrived, fixed], [], np.arange(arrived.size + fixed.size), arrived.size + fixed.size
        while frontier.size:
            known = np.concatenate(rows)
            before = known[frontier] - 1
            ok = before >= 0
            ok[ok] = (self.smaller[before[ok]] == bool(kind)) & (np.searchsorted(self.edges, self.names[before[ok]], "right") - 1 == r)
            parents.append(frontier[ok])
            rows.append(before[ok])
            frontier = known.size + np.arange(int(ok.sum()))
        known, parent = np.concatenate(rows), np.concatenate(parents) if parents else np.zeros(0, np.int64)
        symbol = sign * self.names[known]
        group = np.repeat([0, 2, 1], [arrived.size, fixed.size, parent.size])
        tie = np.concatenate([np.arange(arrived.size), np.arange(fixed.size), np.zeros(parent.size, np.int64)])
        for _ in range(min(len(parents), self.most) + 1):
            order = np.lexsort((tie, group, symbol))
            rank = np.empty(known.size, np.int64)
            rank[order] = np.arange(known.size)
            tie[first:] = rank[parent]
        own = order[group[order] != 2]
        self.at[kind][self.bounds[kind][r] : self.bounds[kind][r] + own.size] = known[own]
        self.filled[r] = self.bounds[kind][r] + own.size
        return known[order]

    def _pass(self, kind: int, ranges: range, fixed_of, sign: int) -> None:  # noqa: ANN001
        for r in ranges:
            lo, hi = fixed_of(r)
            if self.edges[r + 1] - self.edges[r] > 1:
                self._queue(kind, self._arranged(kind, r, np.array(lo(0, hi)), sign), r)
                continue
            at = int(self.bounds[kind][r])  # one name: suffixes are scanned as they arrive
            while at < self.filled[r]:
                end = min(int(self.filled[r]), at + RUN)
                self._queue(kind, np.array(self.at[kind][at:end]), -1)
                at = end
            for start in range(0, hi, RUN):
                self._queue(kind, np.array(lo(start, min(hi, start + RUN))), -1)

    def run(self, seeds: np.ndarray, cuts: np.ndarray) -> None:
        """seeds: LMS suffixes in order, or by first name; cuts: where the seeds of each range begin (one more)."""
        self.filled = self.bounds[0][:-1].copy()
        last = self.names.size - 1
        r = int(np.searchsorted(self.edges, self.names[last], "right") - 1)
        self.at[0][self.filled[r]] = last
        self.filled[r] += 1
        ranges = range(len(self.edges) - 1)
        self._pass(0, ranges, lambda r: (lambda a, b: seeds[cuts[r] + a : cuts[r] + b], int(cuts[r + 1] - cuts[r])), 1)
        larger, ends = self.at[0], self.bounds[0][1:]
        self.filled = self.bounds[1][:-1].copy()
        down = lambda r: (lambda a, b: larger[ends[r] - b : ends[r] - a][::-1], int(ends[r] - self.bounds[0][r]))
        self._pass(1, reversed(ranges), down, -1)

    def ordered(self) -> Iterator[np.ndarray]:
        """Positions in ascending order, run by run; smaller types were stored from the largest down."""
        for r in range(len(self.edges) - 1):
            bounds = [(int(b[r]), int(b[r + 1])) for b in self.bounds]
            if self.edges[r + 1] - self.edges[r] > 1:
                both = np.concatenate([self.at[0][slice(*bounds[0])], self.at[1][slice(*bounds[1])][::-1]])
                yield both[np.argsort(self.names[both], kind="stable")]
                continue
            for start in range(*bounds[0], RUN):
                yield np.array(self.at[0][start : min(bounds[0][1], start + RUN)])
            for end in range(bounds[1][1], bounds[1][0], -RUN):
                yield np.array(self.at[1][max(bounds[1][0], end - RUN) : end])[::-1]


def _cuts(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    if not values.size:
        return [], []
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return first, [*first[1:], values.size]


def equal_pieces(names: np.ndarray, lms: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether pieces ``a`` and ``b`` of a string of names, cut at its LMS positions, are equal over ``most`` names."""
    ends = np.append(lms[1:], names.size - 1)
    lengths = ends[a] - lms[a] + 1
    equal = lengths == ends[b] - lms[b] + 1
    todo, depth = np.flatnonzero(equal), 0
    while todo.size and depth < most:
        same = names[lms[a[todo]] + depth] == names[lms[b[todo]] + depth]
        equal[todo[~same]] = False
        depth += 1
        todo = todo[same & (lengths[todo] > depth)]
    return equal


def induced_order(names: np.ndarray, symbols: int, most: int) -> np.ndarray:
    """Order of the suffixes of a long string of names: the recursion, in files."""
    arrays = Arrays(True)
    try:
        n = names.size
        smaller, lms = typed(names, n, arrays)
        if lms.size:
            pieces = arrays.new(lms.size, np.int64)
            first = NameInduction(names, smaller, symbols, most, arrays)
            seeds = by_symbol(names, lms, symbols, arrays)
            first.run(seeds, _range_cuts(names, seeds, first.edges))
            name, before = -1, np.zeros(0, np.int64)
            for position in first.ordered():
                inner = position > 0
                inner[inner] = smaller[position[inner]] & ~smaller[position[inner] - 1]
                found = np.searchsorted(lms, position[inner])
                if not found.size:
                    continue
                chain = np.concatenate([before, found])
                new = ~equal_pieces(names, lms, chain[:-1], chain[1:], most)
                new = new if before.size else np.append(True, new)
                pieces[found] = name + np.cumsum(new)
                name, before = int(pieces[found[-1]]), found[-1:]
            seeds = arrays.new(lms.size, np.int64)
            inner = sort_names(pieces, name + 1, most)
            for where in runs_of(lms.size):
                seeds[where] = lms[inner[where]]
        else:
            seeds = lms
        final = NameInduction(names, smaller, symbols, most, arrays)
        final.run(seeds, _range_cuts(names, seeds, final.edges))
        out, at = Arrays(True), 0
        order = out.new(n, np.int64)
        _kept.append(out)
        for position in final.ordered():
            order[at : at + position.size] = position
            at += position.size
        return order
    finally:
        arrays.close()


#: Folders of orders that recursion levels have handed up; ``ordered_suffixes`` closes them.
_kept: list[Arrays] = []


def _range_cuts(names: np.ndarray, seeds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    counts = np.zeros(edges.size, np.int64)
    for where in runs_of(seeds.size):
        counts += np.bincount(np.searchsorted(edges, names[seeds[where]], "right"), minlength=edges.size)[: edges.size]
    return np.cumsum(counts)


def sort_names(names: np.ndarray, symbols: int, most: int) -> np.ndarray:
    """Order of the suffixes of a string of names: in memory if it is short, else by induction in files."""
    return ranked_order(names, most) if names.size <= IN_MEMORY else induced_order(names, symbols, most)


def ordered_suffixes(text: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` (bytes; its last one must be the least) in order, with their common-prefix values.

    Values over ``cap`` are ``cap``; suffixes equal over ``cap`` bytes come in any order.
    """
    n = text.size
    if not n:
        return
    arrays = Arrays(n > IN_MEMORY)
    try:
        padded = arrays.new(n + 2 * cap + 16, np.uint8)
        for where in runs_of(n):
            padded[where] = text[where]
        smaller, lms = typed(padded[:n], n, arrays)
        prefixes = np.ones(lms.size, np.int32)
        if lms.size > 1:
            first = Induction(padded, n, smaller, int(FAR), arrays)
            first.run(by_symbol(padded, lms, 256, arrays), None)
            at, lms = lms, sorted_lms(first, lms, n, cap, arrays)
            prefixes = adjacent_prefixes(padded, at, lms, cap, arrays)
        final = Induction(padded, n, smaller, cap, arrays)
        final.run(lms, prefixes)
        yield from final.ordered()
    finally:
        arrays.close()
        while _kept:
            _kept.pop().close()


def sorted_lms(first: Induction, lms: np.ndarray, n: int, cap: int, arrays: Arrays) -> np.ndarray:
    """LMS suffixes in order: their pieces, sorted by the first induction, are named, and the names sorted."""
    number = arrays.new(n, np.int32)
    for where in runs_of(lms.size):
        number[lms[where]] = np.arange(where.start + 1, where.stop + 1)
    name, names, before, least = -1, arrays.new(lms.size, np.int64), -1, FAR
    length_of = lambda k: np.where(k + 1 < lms.size, lms[np.minimum(k + 1, lms.size - 1)] + 1, n) - lms[k]
    for position, prefix in first.ordered():
        found = np.flatnonzero(number[position])
        if not found.size:
            least = min(least, prefix.min())
            continue
        pieces = number[position[found]].astype(np.int64) - 1
        common = np.minimum.reduceat(prefix[: found[-1] + 1], np.append(0, found[:-1] + 1))
        common[0] = min(common[0], least)
        rest = prefix[found[-1] + 1 :]
        least = rest.min() if rest.size else FAR
        previous = np.append(before, pieces[:-1])
        lengths = length_of(pieces)
        new = (previous < 0) | (common < lengths) | (length_of(np.maximum(previous, 0)) != lengths)
        names[pieces] = name + np.cumsum(new)
        name, before = int(names[pieces[-1]]), int(pieces[-1])
    order = sort_names(names, name + 1, max(2, cap))
    out = arrays.new(lms.size, np.int64)
    for where in runs_of(lms.size):
        out[where] = lms[order[where]]
    return out


class Contents:
    """Byte strings end to end, each with a separator, in memory or, over IN_MEMORY bytes, in a file."""

    def __init__(self) -> None:
        self.parts, self.sizes, self.waiting, self.written = [], [], 0, 0
        self.arrays: Arrays | None = None

    def add(self, contents: list[bytes]) -> None:
        self.sizes += [len(c) for c in contents]
        self.parts += [c.translate(_SHIFT) for c in contents]
        self.waiting += sum(map(len, contents)) + len(contents)
        if self.waiting > IN_MEMORY:
            if self.arrays is None:
                self.arrays = Arrays(True)
                self.path = self.arrays.path()
            with open(self.path, "ab") as file:
                file.write(b"\0".join([*self.parts, b""]))
            self.written += self.waiting
            self.parts, self.waiting = [], 0

    def text(self) -> np.ndarray:
        if self.arrays is None:
            return np.frombuffer(b"\0".join([*self.parts, b""]), np.uint8)
        with open(self.path, "ab") as file:
            file.write(b"\0".join([*self.parts, b""]))
        self.written, self.parts, self.waiting = self.written + self.waiting, [], 0
        return np.memmap(self.path, np.uint8, "r", shape=(self.written,))

    def close(self) -> None:
        if self.arrays is not None:
            self.arrays.close()


def repeated_runs(contents: Contents | list[bytes], length: int, copies: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes that start elsewhere too: content, begin and end in it, across.

    A content stands in ``copies`` places, with owners from ``lo`` to ``hi``. Runs with across are those of windows
    that another owner has too; of the others those are given that are not the same as one with across.
    """
    if isinstance(contents, list):
        held, contents = contents, Contents()
        contents.add(held)
    arrays = Arrays(contents.arrays is not None)
    try:
        text, sizes = contents.text(), np.array(contents.sizes)
        ends = np.cumsum(sizes + 1)
        fits, flags = arrays.new(text.size, bool), [arrays.new(text.size + 2, bool) for _ in (0, 1)]
        many = (copies > 1, (copies > 1) & (lo != hi))
        for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            if size >= length:  # no window crosses a separator
                fits[end - 1 - size : end - length] = True
                for f, here in zip(flags, many, strict=True):
                    if here[k]:
                        f[end - size : end - length + 1] = True
        waiting = np.zeros(0, np.int64)

        def settle(members: np.ndarray, new: np.ndarray) -> None:
            """Flag suffixes, in order, that follow an equal one or are followed by one; groups are whole."""
            shared = ~(new & np.append(new[1:], True))
            members, new = members[shared], new[shared]
            if members.size:
                cuts, owner = np.flatnonzero(new), np.searchsorted(ends, members, "right")
                across = np.minimum.reduceat(lo[owner], cuts) != np.maximum.reduceat(hi[owner], cuts)
                flags[0][members + 1] = True
                flags[1][members[np.repeat(across, np.diff(np.append(cuts, members.size)))] + 1] = True

        for position, prefix in ordered_suffixes(text, length):
            inside = fits[position]
            position, equal = position[inside], prefix[inside] >= length  # equal ones have no other between them
            if not position.size:
                continue
            members = np.concatenate([waiting, position])
            new = np.concatenate([np.arange(waiting.size) == 0, ~equal])
            last = int(np.flatnonzero(new)[-1])  # its group may go on
            settle(members[:last], new[:last])
            waiting = members[last:]
        settle(waiting, np.arange(waiting.size) == 0)
        wide, alike = (_edges(f).reshape(-1, 2) for f in flags)
        width = text.size + 1
        wide = wide[~np.isin(wide @ [width, 1], alike @ [width, 1])]
        begin, end = np.concatenate([wide, alike]).T
        content = np.searchsorted(ends, begin, "right")
        start = (ends - sizes - 1)[content]
        return content, begin - start, end - 1 + length - start, np.arange(begin.size) >= len(wide)
    finally:
        arrays.close()
        contents.close()


def _edges(flags: np.ndarray) -> np.ndarray:
    """Where a flag differs from the next one."""
    found = [np.flatnonzero(flags[w.start + 1 : w.stop + 1] != flags[w.start : w.stop]) + w.start for w in runs_of(flags.size - 1)]
    return np.concatenate(found)


#: Bytes go up by one, as 0 separates contents; 0xFF does not occur in UTF-8.
_SHIFT = bytes(min(b + 1, 255) for b in range(256))
