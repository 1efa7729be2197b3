"""Personal data: spans by pattern, and further ones by a semi-Markov conditional random field over whole spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Kinds of spans, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters that an entity may have, and characters around a digit or at sign that are searched.
MAX_TOKENS, MAX_CHARS = 24, 64
#: Windows around personal data, and around other digits and at signs, that the field is fitted on.
SAMPLE = 300
EPOCHS, RATE, DECAY = 30, 0.25, 1e-3
#: Score that a further span needs; 0 is the score of no span in its place.
LEAST = 2.0
#: Characters of windows that are decoded together, and tokens whose candidates are in memory at a time.
CHUNK, BLOCK = 400_000, 20_000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
ANCHOR = re.compile(r"[0-9]+|@|[\[({<]\s{0,2}(?:at|AT)\s{0,2}[\])}>]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern of addresses: the domain after an at sign, then as much before it as may belong.

    The at sign is looked for first, so that a long run without one is read once.
    """
    low, at = 0, text.find("@")
    while at >= 0:
        found = AFTER_AT.match(text, at)
        start = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if found and start < at:
            yield start, found.end()
            low = found.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """Spans by pattern, kind by kind; those of one kind never overlap, those of two kinds may."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in ADDRESS.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches in which every entity lies: more than MAX_CHARS around each digit and at sign, joined where they meet."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        start, end = max(0, m.start() - MAX_CHARS - 8), min(len(text), m.end() + MAX_CHARS + 8)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


# Classes of characters: each digit or letter run is one token, every other character is one.
DIGIT, LETTER, SPACE, DOT, AT, HYPHEN, PLUS, OPEN, CLOSE, LOW, COMMA, SLASH, COLON, OTHER, AT_WORD, DOT_WORD, BREAK = range(17)
_CLASS = np.full(128, OTHER, np.int8)
for _c, _chars in ((DIGIT, "0123456789"), (LETTER, LOCAL[:52]), (SPACE, " \t"), (DOT, "."), (AT, "@"), (HYPHEN, "-"), (PLUS, "+"), (OPEN, "([{<"), (CLOSE, ")]}>"), (LOW, "_%"), (COMMA, ","), (SLASH, "/"), (COLON, ":;"), (BREAK, "\n\r")):
    _CLASS[[ord(x) for x in _chars]] = _c


@dataclass
class Tokens:
    """Tokens of many windows, one after the other, with a break before and after each."""

    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray  # all characters
    sums: dict[str, np.ndarray]  # counts before each token


def tokens(pieces: list[str]) -> Tokens:
    joined = "\n" + "\n".join(pieces) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < 128, _CLASS[np.minimum(code, 127)], LETTER)
    first = np.ones(kind.size, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > LETTER)
    start = np.flatnonzero(first)
    end = np.append(start[1:], kind.size)
    kind, value = kind[start].astype(np.int64), np.full(start.size, -1, np.int64)
    short = np.flatnonzero((kind == DIGIT) & (end - start <= 3))
    value[short] = 0
    for k in range(3):
        some = short[start[short] + k < end[short]]
        value[some] = value[some] * 10 + code[start[some] + k] - 48
    for k in np.flatnonzero((kind == LETTER) & (end - start <= 3)).tolist():
        word = joined[start[k] : end[k]].lower()
        if word in ("at", "dot"):
            kind[k] = AT_WORD if word == "at" else DOT_WORD
    size = end - start
    counted = {
        "digit": (kind == DIGIT) * size, "run": kind == DIGIT, "letter": np.isin(kind, (LETTER, AT_WORD, DOT_WORD)) * size, "at": kind == AT, "at_word": kind == AT_WORD,
        "dot": kind == DOT, "dot_word": kind == DOT_WORD, "space": kind == SPACE, "hyphen": kind == HYPHEN, "plus": kind == PLUS, "bracket": (kind == OPEN) | (kind == CLOSE),
        "break": kind == BREAK, "other": np.isin(kind, (LOW, COMMA, SLASH, COLON, OTHER)), "large": (kind == DIGIT) & ((value < 0) | (value > 255)),
    }
    return Tokens(kind, start, end, code, {k: np.concatenate([[0], np.cumsum(v.astype(np.int64))]) for k, v in counted.items()})


@dataclass
class Candidates:
    """Stretches of tokens [first, last) that may be entities, ordered by last, with the value of each feature."""

    first: np.ndarray
    last: np.ndarray
    values: np.ndarray  # (candidate, feature): the column of the weights that it picks


#: Features and how many values each has.
SIZES = {
    "digits": 21, "runs": 7, "letters": 4, "ats": 9, "dots": 30, "spaces": 6, "hyphens": 5, "pluses": 3, "brackets": 5, "others": 4, "first": 17, "last": 17,
    "before": 17, "after": 17, "luhn": 3, "octets": 3, "first_run": 6, "last_run": 6, "longest_run": 9, "separator": 18, "length": 9, "tail": 4, "runs_digits": 147,
}
OFFSETS = np.concatenate([[0], np.cumsum(list(SIZES.values()))])


def candidates(t: Tokens, low: int = 0, high: int | None = None) -> Candidates:
    """Stretches that begin with a digit, letter, plus or bracket, end with a digit or letter, hold a digit or at sign, have no
    break and end after ``low`` and not after ``high``. Their whole-span features come from the running sums."""
    kind, counted, size = t.kind, t.sums, t.end - t.start
    high = kind.size if high is None else high
    begins = max(0, low - MAX_TOKENS) + np.flatnonzero(np.isin(kind[max(0, low - MAX_TOKENS) : high], (DIGIT, LETTER, PLUS, OPEN)))
    ends = (kind == DIGIT) | (kind == LETTER)
    found = []
    for length in range(1, MAX_TOKENS + 1):
        a = begins[(begins + length > low) & (begins + length <= high)]
        b = a + length
        total = lambda k, a=a, b=b: counted[k][b] - counted[k][a]
        ok = ends[b - 1] & (total("break") == 0) & (t.end[b - 1] - t.start[a] <= MAX_CHARS) & ((total("run") > 0) | (total("at") > 0) | ((total("at_word") > 0) & (total("bracket") > 1)))
        found.append(np.stack([a[ok], b[ok]]))
    a, b = np.concatenate(found, axis=1)
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    n = {k: v[b] - v[a] for k, v in counted.items()}
    # the digit runs of a candidate: the first, the last, the longest
    run = np.append(size[kind == DIGIT], 0)
    one, past = counted["run"][a], counted["run"][b]
    first_run, last_run = np.where(past > one, run[one], 0), np.where(past > one, run[past - 1], 0)
    longest = np.zeros(a.size, np.int64)
    for k in range(MAX_TOKENS):
        longest = np.maximum(longest, np.where(one + k < past, run[np.minimum(one + k, run.size - 1)], 0))
    after_first = np.where(b - a > 1, kind[np.minimum(a + 1, kind.size - 1)], 17)
    values = {
        "digits": np.minimum(n["digit"], 20), "runs": np.minimum(n["run"], 6), "letters": np.digitize(n["letter"], (1, 3, 11)), "ats": np.minimum(n["at"], 2) * 3 + np.minimum(n["at_word"], 2),
        "dots": np.minimum(n["dot"], 4) * 6 + np.minimum(n["dot_word"], 2) * 2 + (n["at"] + n["at_word"] > 0), "spaces": np.minimum(n["space"], 5), "hyphens": np.minimum(n["hyphen"], 4), "pluses": np.minimum(n["plus"], 2),
        "brackets": np.minimum(n["bracket"], 4), "others": np.minimum(n["other"], 3), "first": kind[a], "last": kind[b - 1], "before": kind[a - 1], "after": kind[np.minimum(b, kind.size - 1)],
        "luhn": checked(t, a, b, n), "octets": np.where(n["run"] == 4, 1 + (n["large"] > 0), 0), "first_run": np.minimum(first_run, 5), "last_run": np.minimum(last_run, 5), "longest_run": np.minimum(longest, 8),
        "separator": after_first, "length": np.minimum((t.end[b - 1] - t.start[a]) // 6, 8), "tail": np.minimum(size[b - 1], 4) - 1, "runs_digits": np.minimum(n["run"], 6) * 21 + np.minimum(n["digit"], 20),
    }
    return Candidates(a, b, (np.stack([values[k] for k in SIZES], axis=1) + OFFSETS[:-1]).astype(np.int16))


def checked(t: Tokens, a: np.ndarray, b: np.ndarray, n: dict[str, np.ndarray]) -> np.ndarray:
    """1 or 2 for 13 to 19 digits without letters, 2 if the check digit holds; else 0."""
    out = np.zeros(a.size, np.int64)
    for k in np.flatnonzero((n["digit"] >= 13) & (n["digit"] <= 19) & (n["letter"] == 0)).tolist():
        code = t.code[t.start[a[k]] : t.end[b[k] - 1]]
        digits = code[(code >= 48) & (code <= 57)].astype(np.int64)[::-1] - 48
        double = 2 * digits[1::2]
        out[k] = 1 + ((digits[::2].sum() + (double - 9 * (double > 9)).sum()) % 10 == 0)
    return out


def score(weights: np.ndarray, c: Candidates) -> np.ndarray:
    """Score of every candidate as an entity of every kind; no entity scores 0."""
    out = np.zeros((c.first.size, len(KINDS)), np.float32)
    for f in range(len(SIZES)):
        out += weights[c.values[:, f]]
    return out


def best_path(t: Tokens, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, first, last, score) of the entities of the best cut of all tokens into entities and single other tokens.

    The value of the best cut up to each token follows from those before it. A candidate that scores no more than its
    tokens by themselves can't belong to a best cut and is left out. Ties go to the candidate that ends, then begins
    first. Candidates are made for BLOCK tokens at a time, so memory does not grow with them.
    """
    ends, values, chosen = [0], [0.0], [(0, 0, 0, 0.0)]  # the value steps up at the ends of entities only
    for low in range(0, t.kind.size, BLOCK):
        c = candidates(t, low, min(low + BLOCK, t.kind.size))
        scores = score(weights, c)
        kinds, gains = scores.argmax(axis=1), scores.max(axis=1)
        for k in np.flatnonzero(gains > 0).tolist():
            first, last, gain = int(c.first[k]), int(c.last[k]), float(gains[k])
            value = values[bisect_right(ends, first) - 1] + gain
            if value > values[-1]:
                if ends[-1] == last:
                    ends.pop(), values.pop(), chosen.pop()
                ends.append(last), values.append(value), chosen.append((int(kinds[k]), first, last, gain))
    out, at = [], bisect_right(ends, t.kind.size) - 1
    while at:
        out.append(chosen[at])
        at = bisect_right(ends, chosen[at][1]) - 1
    return out[::-1]


def joint(t: Tokens, c: Candidates, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of every candidate and kind over all cuts, and the logarithm of the sum of all cuts.

    Stretches between breaks are cut by themselves; forward and backward sums walk through all of them in lockstep.
    """
    unit = np.cumsum(t.kind == BREAK)
    origin = np.flatnonzero(t.kind == BREAK)
    u = unit[c.first] - 1
    i, j = c.first - origin[u], c.last - origin[u]
    top = int(j.max(initial=1))
    total = np.logaddexp.reduce(scores, axis=1)
    sums = []
    for here, there, ahead in ((j, i, 1), (i, j, -1)):
        order = np.lexsort((u, here))
        table = np.zeros((top + 1, origin.size))
        places = range(1, top + 1) if ahead == 1 else range(top - 1, -1, -1)
        cuts = np.searchsorted(here[order], np.arange(top + 2))
        for at in places:
            table[at] = table[at - ahead]
            mine = order[cuts[at] : cuts[at + 1]]
            if mine.size:
                units, first = np.unique(u[mine], return_index=True)
                table[at, units] = np.logaddexp(table[at, units], np.logaddexp.reduceat(table[there[mine], u[mine]] + total[mine], first))
        sums.append(table)
    before, after = sums
    return np.exp(scores + (before[i, u] + after[j, u] - before[top, u])[:, None]), float(before[top].sum())


def apart(spans: list[Span]) -> list[Span]:
    """Of spans that overlap, the one of the first kind of email, phone, card and ip, then the first one."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: ((0, 3, 2, 1)[s[0]], s[1])):
        if all(s[2] <= x[1] or x[2] <= s[1] for x in out):
            out.append(s)
    return sorted(out, key=lambda s: s[1])


def disguised(piece: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The piece with each span in another spelling that its pattern misses, or broken so that it is none any more."""
    text, out, at = "", [], 0
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    for kind, start, end in spans:
        text += piece[at:start]
        old, real = piece[start:end], rng.random() < 0.7
        digits = NOT_DIGIT.sub("", old)
        if kind == 0:
            name, _, host = old.rpartition("@")
            new = name + pick(" @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}") + host.replace(".", pick(".", ".", " dot ", "[dot]", "[.]")) if real else pick(name + "@", name + " " + host, host)
        elif kind == 1:
            parts = old.split(".")
            new = pick(" . ", "[.]", "(.)", "[dot]").join(parts) if real else ".".join([*parts[:3], str(300 + int(rng.integers(600)))])
        elif kind == 2:
            groups = [digits[k : k + 4] for k in range(0, len(digits), 4)]
            wrong = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 9))) % 10)
            new = pick(".", "/", "_", "  ", " - ").join(groups) if real else pick(wrong, digits[:9], digits + wrong)
        else:
            short = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", old)
            new = pick("00" + old[1:], short, short.replace(" ", ""), old[1:], old.replace("-", "/")) if real else pick(digits, digits[:5], digits[:3] + "-" + digits[3:5])
        if real:
            out.append((kind, len(text), len(text) + len(new)))
        text += new
        at = end
    return text + piece[at:], out


def fit(pieces: list[tuple[str, list[Span]]], seed: int = 11) -> np.ndarray:
    """Weights (feature value, kind) that make the given spans likely among all cuts of the pieces.

    Each piece with spans also counts with its spans disguised. Steps follow the gradient, counts of the features in
    the given spans less those expected, scaled by its own size so far.
    """
    rng = np.random.default_rng(seed)
    both = pieces + [disguised(p, spans, rng) for p, spans in pieces for _ in range(2) if spans]
    t = tokens([p for p, _ in both])
    c = candidates(t)
    place = {(a, b): k for k, (a, b) in enumerate(zip(t.start[c.first].tolist(), t.end[c.last - 1].tolist(), strict=True))}
    gold, origin = np.zeros((c.first.size, len(KINDS)), np.float32), 1
    for piece, spans in both:
        for kind, a, b in spans:
            k = place.get((origin + a, origin + b))
            if k is not None:
                gold[k, kind] = 1
        origin += len(piece) + 1
    weights = np.zeros((int(OFFSETS[-1]), len(KINDS)), np.float32)
    columns = c.values.astype(np.int64)
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, EPOCHS + 1):
        chance, _ = joint(t, c, score(weights, c))
        error = gold - chance
        g = np.stack([sum(np.bincount(columns[:, f], error[:, k], weights.shape[0]) for f in range(len(SIZES))) for k in range(len(KINDS))], axis=1) / len(both) - DECAY * weights
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        weights += (RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return weights


def without(text: str, spans: list[Span]) -> str:
    """The text with line ends in place of the spans, which may overlap."""
    parts, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        parts += [text[at : max(a, at)], "\n" * (b - max(a, at))]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def further(texts: list[str], weights: np.ndarray, taken: list[list[Span]], least: float = LEAST) -> list[list[Span]]:
    """Entities of the field in every text, outside the spans that are taken, with ``least`` score or more."""
    out: list[list[Span]] = [[] for _ in texts]
    pieces: list[str] = []
    owners: list[tuple[int, int]] = []

    def decode() -> None:
        t = tokens(pieces)
        origins = np.cumsum([1, *[len(p) + 1 for p in pieces]])
        for kind, first, last, gain in best_path(t, weights):
            if gain >= least:
                a, b = int(t.start[first]), int(t.end[last - 1])
                p = int(np.searchsorted(origins, a, "right")) - 1
                text, at = owners[p]
                out[text].append((kind, a - int(origins[p]) + at, b - int(origins[p]) + at))
        pieces.clear(), owners.clear()

    held = 0
    for n, (text, spans) in enumerate(zip(texts, taken, strict=True)):
        text = without(text, spans) if spans else text
        for a, b in windows(text):
            pieces.append(text[a:b])
            owners.append((n, a))
            held += b - a
        if held > CHUNK:
            decode()
            held = 0
    if pieces:
        decode()
    return out


def learned(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights fitted on a bounded sample of windows of all texts, whose spans by pattern count as the truth.

    Of the different windows of up to 400 characters, those with the least hashes are taken: ``sample`` with spans and
    as many without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                if text and ANCHOR.search(text):
                    spans, near = apart(base_spans(text)), 0
                    for a, b in windows(text):
                        while near < len(spans) and spans[near][2] <= a:
                            near += 1
                        inside = []
                        for kind, start, end in spans[near:]:
                            if start >= b:
                                break
                            inside.append([kind, start - a, end - a])
                        if b - a <= 400 and all(s[1] >= 0 and s[2] <= b - a for s in inside):
                            found.append((text[a:b], inside))
            pieces, marks = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(marks, pa.list_(pa.list_(pa.int64())))], ["piece", "spans"])

    found = stored(docs.select("text").mapInArrow(run, "piece string, spans array<array<long>>").distinct())
    order = [F.xxhash64("piece"), F.col("piece")]
    rows = [r for some in (F.size("spans") > 0, F.size("spans") == 0) for r in found.where(some).orderBy(*order).limit(sample).collect()]
    marked = [(r["piece"], [tuple(s) for s in r["spans"]]) for r in rows]
    return fit(marked) if any(spans for _, spans in marked) else None


def find_spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, spans) of every whole text; a span is (kind, start, end, base), in code points, end exclusive.

    Spans by pattern (base) are leftmost and don't overlap others of their kind. The field adds spans outside of them,
    by the best cut of the rest of the text into entities of up to MAX_TOKENS tokens and MAX_CHARS characters, each with a
    digit or at sign, and other tokens. It is fitted on the texts themselves (see ``learned``); without any span by
    pattern it adds none. Spans are ordered by kind, then start. Null and empty texts have none; repeated rows give
    equal rows; null ids stay; very long texts are read whole, their candidates in blocks; an empty table gives no
    rows; other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(learned(docs))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = further(texts, weights.value, base, least) if weights.value is not None else [[] for _ in texts]
            both = [sorted([(*s, True) for s in b] + [(*s, False) for s in m]) for b, m in zip(base, more, strict=True)]
            rows = [[{"kind": KINDS[k], "start": a, "end": e, "base": known} for k, a, e, known in spans] for spans in both]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    kinds = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans by pattern of each kind, the digest of them, all spans, and how many the field added."""
    found = find_spans(docs)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), added)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or joint stretch of overlapping ones, replaced by the first one's kind in brackets."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])
