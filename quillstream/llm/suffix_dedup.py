"""Exact substring dedup over whole corpora: suffix sorting in shards that keep equal strings together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestream import in_chunks, joined, word_bounds
from .common import stored
from .shingles import mixed
from .suffixes import Contents, repeated_runs

#: Bytes of the strings that count as repeated, and of those that make up a passage.
LENGTH, PASSAGE = 400, 250
#: A passage has more words than this, so at least so many bytes.
WORDS = 50
SHORTEST = 2 * WORDS + 1
#: Bytes of the strings whose least hash in a window anchors the window, for short windows, and for long ones.
ANCHOR, LONG_ANCHOR = 64, 200
#: Bytes of text that one shard sorts, on average, and that a scan holds at a time.
SHARD, CHUNK, LONGEST = 3_000_000, 2_000_000, 8_000_000
#: Bytes of different contents of one anchor over which its windows are anchored anew by another hash, and how often.
HOT, LEVELS = 4 * SHARD, 2

_rng = np.random.default_rng(20240607)
_TABLES = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64)
_BASES = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93]
_PLACE = np.uint64((1 << 24) - 1)
#: What tells the rows of a table of texts apart: the document, a hash of its whole text, and where the piece starts.
ROW = ["doc", "key", "at"]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Rolling:
    """Polynomial hashes, modulo 2^64, of any substring of a byte string from one running sum."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        base = _BASES[which]
        self.up = _powers(base, data.size + 1)
        self.total = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * _powers(pow(base, -1, 2**64), data.size), out=self.total[1:])

    def raw(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.up[ends]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends) + (ends - starts).astype(np.uint64))


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, level: int = 0) -> tuple[np.ndarray, ...]:
    """All windows of ``length`` bytes of every text, as stretches of windows with one anchor.

    The anchor of a window is its string of ANCHOR bytes (LONG_ANCHOR where few texts are left to scan; half a window
    at most) of least hash, the first of equal ones, so that equal windows have equal anchors wherever they stand;
    every level has its own hash. Returns of every
    stretch the text, where it starts in it, its bytes (of all its windows), the anchor's hash and a hash of the bytes.
    """
    anchored = max(1, min(LONG_ANCHOR if level or length >= LENGTH else ANCHOR, length // 2))
    width = length - anchored + 1
    n = data.size - anchored + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Rolling(data, 0).raw(slice(0, n), slice(anchored, n + anchored))
    if level:
        hashes = mixed(hashes + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
    packed = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
    rows = np.concatenate([packed, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    anchor = (np.minimum(behind[starts], ahead[starts + width - 1]) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
    inside = owner[starts] == owner[starts + length - 1]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (owner[starts[1:]] != owner[starts[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts.size) - 1
    first, last = first[inside[first]], last[inside[first]]
    text, ends = owner[first], last + length
    return text, first - offsets[text], ends - first, mixed(hashes[anchor[first]]), Rolling(data, 1)(first, ends)


def word_windows(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Windows of WORDS + 1 words that have fewer than ``size`` bytes: text, start, bytes and two hashes of the window.

    Equal windows of one text that meet, as where few words repeat over and over, are one stretch from the first to the
    end of the last. Long texts are cut with an overlap of ``size`` bytes and one more at either end, by which words are
    told from parts of words; a window belongs to the part in which it starts.
    """
    cut = [(k, at) for k, t in enumerate(texts) for at in range(0, max(1, len(t)), LONGEST)]
    parts = [texts[k][max(0, at - 1) : at + LONGEST + size] for k, at in cut]
    data, offsets = joined(parts)
    starts, ends, _ = word_bounds(data, offsets)
    first, last = starts[: max(0, starts.size - WORDS)], ends[WORDS:]
    owner = np.searchsorted(offsets, first, "right") - 1
    short = np.flatnonzero((last - first < size) & (last <= offsets[owner + 1]))
    owner, first, last = owner[short], first[short], last[short]
    text, at = (np.array(x, np.int64)[owner] for x in zip(*cut, strict=True)) if cut else (owner, owner)
    begin = first - offsets[owner] + np.maximum(at - 1, 0)
    mine = (begin >= at) & (begin < at + LONGEST)
    owner, first, last, text, begin = (x[mine] for x in (owner, first, last, text, begin))
    used, place = np.unique(owner, return_inverse=True)  # only parts with such windows are hashed
    rows, bounds = joined([parts[k] for k in used.tolist()])
    a = first - offsets[owner] + bounds[place]
    hashes = [Rolling(rows, k)(a, a + last - first) if a.size else np.zeros(0, np.uint64) for k in (0, 1)]
    order = np.lexsort((begin, *hashes, text))
    text, begin, bytes_, one, two = (x[order] for x in (text, begin, last - first, *hashes))
    if not text.size:
        return text, begin, bytes_, one, two
    same = (text[1:] == text[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    new = np.flatnonzero(np.append(True, ~same | (begin[1:] > begin[:-1] + bytes_[:-1])))
    until = np.append(new[1:] - 1, text.size - 1)
    return text[new], begin[new], begin[until] + bytes_[until] - begin[new], one[new], two[new]


def scanned(texts: DataFrame, length: int, level: int, words: bool = False) -> DataFrame:
    """The stretches of all texts: their columns but the text, then start, size, anchor, digest. Texts longer than
    LONGEST are cut with an overlap that leaves every window in one part. With ``words`` each window of WORDS + 1 words
    that is too short for a window of ``length`` bytes is a stretch of its own, anchored by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            texts = batch.column("text").to_pylist()
            pieces = [(row, at) for row, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), LONGEST)]
            parts = [texts[row][at : at + LONGEST + length - 1] for row, at in pieces]
            for start, end in in_chunks(parts, CHUNK):
                part, begin, size, anchor, digest = stretches(*joined(parts[start:end]), length, level)
                row = np.array([pieces[start + k][0] for k in range(end - start)], np.int64)[part]
                shift = np.array([pieces[start + k][1] for k in range(end - start)], np.int64)[part]
                taken = rest.take(pa.array(row))
                columns = [*taken.columns, pa.array(begin + shift), pa.array(size), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "start", "size", "anchor", "digest"])
            for start, end in in_chunks(texts, CHUNK) if words else ():
                text, begin, size, anchor, digest = word_windows(texts[start:end], length)
                columns = [*rest.take(pa.array(start + text)).columns, pa.array(begin), pa.array(size), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "start", "size", "anchor", "digest"])

    own = ", ".join(f"{n} {t}" for n, t in texts.dtypes if n != "text")
    return texts.where(F.octet_length("text") >= (SHORTEST if words else length)).mapInArrow(run, f"{own}, start long, size long, anchor long, digest long")


def named(docs: DataFrame) -> DataFrame:
    """doc, key (a hash of the text), at (0), the text as bytes, null counting as empty, and the other columns as row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    row = F.struct(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("_"))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("key"), F.lit(0).cast("long").alias("at"), text.alias("bytes"), row.alias("row"))


def whole_texts(docs: DataFrame) -> DataFrame:
    return named(docs).select(*ROW, F.col("bytes").alias("text"))


def cut_out(suspects: DataFrame) -> DataFrame:
    """The bytes of the wanted stretches, with what else is wanted of them, from (text, wanted)."""
    fields = [f.name for f in suspects.schema["wanted"].dataType.elementType.fields if f.name not in ("start", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                text = text.as_py()
                columns = [pa.array([w[k] for w in wanted], pa.int64()) for k in fields]
                columns.append(pa.array([text[w["start"] : w["start"] + w["size"]] for w in wanted], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*fields, "content"])

    rows = suspects.where(F.size("wanted") > 0).select("text", "wanted")
    return rows.mapInArrow(run, ", ".join(f"{f} long" for f in fields) + ", content binary")


RUNS = "anchor long, digest long, begin long, end long, across boolean"


def sorted_runs(contents: DataFrame, length: int, shards: int) -> DataFrame:
    """RUNS of the contents with windows that occur elsewhere, by sorting the suffixes of every shard."""

    def settled(shard: Contents, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        numbers = (table.column(c).to_numpy() for c in ("copies", "lo", "hi"))
        content, *columns = repeated_runs(shard, length, *numbers)
        names = [table.column(c).combine_chunks().take(pa.array(content)) for c in ("anchor", "digest")]
        return pa.RecordBatch.from_arrays([*names, *map(pa.array, columns)], ["anchor", "digest", "begin", "end", "across"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, rows = None, Contents(), []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if rows and numbers[at] != current:
                    yield settled(shard, rows)
                    shard, rows = Contents(), []
                current = numbers[at]
                part = batch.slice(at, end - at)
                shard.add(part.column("content").to_pylist())
                rows.append(part.drop_columns(["shard", "content"]))
        if rows:
            yield settled(shard, rows)

    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select("shard", "anchor", "digest", "copies", "lo", "hi", "content")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, RUNS)


def windows_of(contents: DataFrame, length: int) -> DataFrame:
    """Every window of the contents, as 128 bits of hashes: anchor, digest, copies, lo, hi, begin, one, two."""
    rest = ["anchor", "digest", "copies", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("content").to_pylist()
            for start, end in in_chunks(texts, CHUNK // 8):
                data, offsets = joined(texts[start:end])
                n = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(n.size), n)
                begin = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] + begin
                columns = [batch.column(c).take(pa.array(row + start)) for c in rest]
                columns += [pa.array(begin), *(pa.array(Rolling(data, k)(at, at + length).view(np.int64)) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "begin", "one", "two"])

    return contents.mapInArrow(run, ", ".join(f"{c} long" for c in [*rest, "begin", "one", "two"]))


def counted_runs(contents: DataFrame, length: int) -> DataFrame:
    """RUNS of contents whose windows share all their anchors: windows are counted, with partial sums first."""
    windows = stored(windows_of(contents, length))
    often = windows.groupBy("one", "two").agg(F.sum("copies").alias("n"), (F.min("lo") != F.max("hi")).alias("across")).where("n > 1")
    found = windows.join(often.drop("n"), ["one", "two"]).groupBy("anchor", "digest")
    found = found.agg(*(F.sort_array(F.collect_set(F.when(c, F.col("begin")))).alias(n) for n, c in (("wide", F.lit(True)), ("all_over", F.col("across")))))

    def runs(begins: str):
        first = F.filter(begins, lambda x, i: F.coalesce(F.get(begins, i - 1) < x - 1, F.lit(True)))
        last = F.filter(begins, lambda x, i: F.coalesce(F.get(begins, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda x, y: F.struct(x.alias("begin"), (y + length).alias("end")))

    both = [found.select("anchor", "digest", F.explode(runs(n)).alias("r"), F.lit(n == "all_over").alias("across")) for n in ("wide", "all_over")]
    return both[0].union(both[1]).select("anchor", "digest", "r.begin", "r.end", "across")


def repeated_spans(texts: DataFrame, length: int, hot: int = HOT, level: int = 0, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spans of ``texts`` (doc, key, at, text) whose windows of ``length`` bytes start anywhere else, and suspects.

    With ``words`` also spans of WORDS + 1 words in fewer bytes that start anywhere else.

    Spans are (doc, key, at, begin, end, across): runs of repeated windows, in pieces that may overlap, and, with
    across, runs of windows that another document has too. Suspects are the texts that may have spans.

    1. A scan stores the stretches of windows that share an anchor; those of anchors that occur once are dropped.
    2. Equal stretches are counted, with partial sums first. An anchor with one content is settled by its count.
    3. Of the others one example of each content is cut out of its text; contents meet by hash of the anchor in shards
       of about SHARD bytes, where all suffixes are sorted. Anchors with over ``hot`` bytes of contents, such as a
       passage with ever other neighbours, are split before: their windows are anchored anew by another hash, LEVELS
       times; windows that share all of these anchors are counted over all tasks.
    4. The repeated runs go back to every place of their content; a run without an end is the whole stretch.
    """
    found = stored(scanned(texts, length, level, words))
    copies = F.col("copies") if "copies" in found.columns else F.lit(1).cast("long")
    lo, hi = (F.col("lo"), F.col("hi")) if "copies" in found.columns else (F.xxhash64("doc", "key"),) * 2
    often = stored(found.groupBy("anchor").agg(F.sum(copies).alias("n")).where("n > 1").select("anchor"))
    near = stored(found.join(often.hint("shuffle_hash"), "anchor", "left_semi"))
    contents = near.groupBy("anchor", "digest").agg(
        F.sum(copies).alias("copies"), F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.min(F.struct(*ROW, "start", "size")).alias("place")
    )
    contents = stored(contents)
    sizes = stored(contents.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("place.size").alias("total")))
    contents = stored(contents.join(sizes, "anchor").withColumn("kind", F.when(F.col("n") == 1, 0).when(F.col("total") <= hot, 1).otherwise(2)))
    fields = ["anchor", "digest", "copies", "lo", "hi", "kind", "start", "size"]
    wanted = contents.where("kind > 0").select("place.*", *fields[:6]).select(*ROW, F.struct(*fields).alias("w"))
    rows = near.select(*ROW).distinct().withColumn("w", F.lit(None).cast(wanted.schema["w"].dataType)).unionByName(wanted)
    asked = rows.groupBy(*ROW).agg(F.collect_list("w").alias("wanted")).select(*(F.col(c).alias(f"_{c}") for c in ROW), "wanted")
    suspects = stored(texts.where(F.octet_length("text") >= (SHORTEST if words else length)).join(asked.hint("shuffle_hash"), _same_row()).select(*texts.columns, "wanted"))

    totals = {r["kind"]: r["bytes"] for r in contents.groupBy("kind").agg(F.sum("place.size").alias("bytes")).collect()}
    runs = contents.where("kind = 0").select("anchor", "digest", F.lit(0).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), (F.col("lo") != F.col("hi")).alias("across"))
    if 1 in totals:
        few = cut_out(suspects.withColumn("wanted", F.filter("wanted", lambda w: w["kind"] == 1)))
        runs = runs.unionByName(stored(sorted_runs(few, length, max(1, -(-totals[1] // SHARD)))))
    if 2 in totals:
        many = cut_out(suspects.withColumn("wanted", F.filter("wanted", lambda w: w["kind"] == 2)))
        if level < LEVELS:
            again = many.select(F.col("anchor").alias("doc"), F.col("digest").alias("key"), F.lit(0).cast("long").alias("at"), "copies", "lo", "hi", F.col("content").alias("text"))
            split = repeated_spans(stored(again), length, hot, level + 1)[0]
            runs = runs.unionByName(split.select(F.col("doc").alias("anchor"), F.col("key").alias("digest"), "begin", "end", "across"))
        else:
            runs = runs.unionByName(stored(counted_runs(many, length)))
    places = near.select(*ROW, "start", "size", "anchor", "digest").join(runs, ["anchor", "digest"])
    spans = places.select(*ROW, (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.coalesce("end", "size")).alias("end"), "across")
    return spans, suspects


def _same_row() -> Column:
    return F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at"))


def by_row(spans: DataFrame) -> DataFrame:
    """The spans of every row as one array, under names that do not clash."""
    return spans.groupBy(*(F.col(c).alias(f"_{c}") for c in ROW)).agg(F.collect_set(F.struct("begin", "end", "across")).alias("spans"))


class Spans:
    """The spans of a batch of texts as arrays, with the texts end to end."""

    def __init__(self, texts: list[bytes], spans: pa.Array) -> None:
        self.texts, (self.data, self.offsets) = texts, joined(texts)
        inner = spans.flatten()
        counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.begin, self.end = (self.offsets[self.row] + inner.field(k).to_numpy() for k in ("begin", "end"))
        self.across = inner.field("across").to_numpy(zero_copy_only=False)

    def merged(self, across: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, begin and end of the maximal runs that all spans (or those across documents) cover."""
        chosen = np.flatnonzero(self.across) if across else np.arange(self.row.size)
        chosen = chosen[np.lexsort((self.begin[chosen], self.row[chosen]))]
        if not chosen.size:
            return (np.zeros(0, np.int64),) * 3
        begin, reach = self.begin[chosen], np.maximum.accumulate(self.end[chosen])
        row = self.row[chosen]
        first = np.flatnonzero(np.append(True, (begin[1:] > reach[:-1]) | (row[1:] != row[:-1])))
        return row[first], begin[first], reach[np.append(first[1:] - 1, row.size - 1)]

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, begin and end of the maximal runs that other documents have too, with over WORDS words in whole or part."""
        row, begin, end = self.merged(True)
        starts, ends, _ = word_bounds(self.data, self.offsets)
        many = np.searchsorted(starts, end) - np.searchsorted(ends, begin, "right") > WORDS
        return row[many], begin[many], end[many]

    def without(self, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The texts without these runs."""
        out, at = list(self.texts), self.offsets[row]
        for k, b, e in zip(row[::-1].tolist(), (begin - at)[::-1].tolist(), (end - at)[::-1].tolist(), strict=True):
            out[k] = out[k][:b] + out[k][e:]
        return out


def judged(found: DataFrame) -> DataFrame:
    """Of suspects with their spans: doc, key, n_passages, the text if it has longer runs, and where these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = Spans(batch.column("text").to_pylist(), batch.column("spans"))
            count = np.bincount(spans.passages()[0], minlength=batch.num_rows)
            row, begin, end = spans.merged()
            long = end - begin >= LENGTH
            row, begin, end = row[long], (begin - spans.offsets[row])[long], (end - spans.offsets[row])[long]
            bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"]))
            text = pc.if_else(pc.greater(pc.list_value_length(runs), 0), batch.column("text"), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(count), text, runs], ["doc", "key", "n_passages", "text", "runs"])

    return found.mapInArrow(run, "doc long, key long, n_passages long, text binary, runs array<struct<begin: long, end: long>>")


def cut_texts(found: DataFrame, runs_of: Callable[[Spans], tuple]) -> DataFrame:
    """``found`` with n_removed, n_spans and kept, what is left, instead of its text and spans (null: none)."""
    rest = [f"`{n}` {t}" for n, t in found.dtypes if n not in ("text", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = Spans(batch.column("text").to_pylist(), batch.column("spans"))
            row, begin, end = runs_of(spans)
            others = batch.drop_columns(["text", "spans"])
            removed = np.bincount(row, end - begin, batch.num_rows).astype(np.int64)
            columns = [*others.columns, pa.array(removed), pa.array(np.bincount(row, minlength=batch.num_rows))]
            columns.append(pa.array(spans.without(row, begin, end), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*others.schema.names, "n_removed", "n_spans", "kept"])

    return found.mapInArrow(run, ", ".join([*rest, "n_removed long, n_spans long, kept binary"]))


def removals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, key, n_passages, n_removed, n_spans, kept (null if nothing goes) of the texts with repeated strings.

    Strings of LENGTH bytes that occur again lie in runs of repeated strings of PASSAGE bytes, which are found first;
    only such runs of LENGTH bytes or more are searched for the longer strings.
    """
    spans, suspects = repeated_spans(whole_texts(docs), PASSAGE, hot, words=True)
    known = stored(judged(suspects.join(by_row(spans).hint("shuffle_hash"), _same_row()).select("doc", "key", "text", "spans")))
    runs = known.where("text IS NOT NULL").select("doc", "key", "text", F.explode("runs").alias("r"))
    pieces = stored(runs.select("doc", "key", F.col("r.begin").alias("at"), F.substring(F.col("text"), F.col("r.begin") + 1, F.col("r.end") - F.col("r.begin")).alias("text")))
    longer = repeated_spans(pieces, LENGTH, hot)[0].select("doc", "key", F.lit(0).cast("long").alias("at"), (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end"), "across")
    found = known.withColumn("at", F.lit(0).cast("long")).join(by_row(longer), _same_row(), "left")
    cut = cut_texts(found.where("spans IS NOT NULL").select("doc", "key", "n_passages", "text", "spans"), Spans.merged)
    nothing = F.lit(0).cast("long")
    whole = found.where("spans IS NULL").select("doc", "key", "n_passages", nothing.alias("n_removed"), nothing.alias("n_spans"), F.lit(None).cast("binary").alias("kept"))
    return cut.unionByName(whole).dropDuplicates(["doc", "key"])


def remove_repeats(docs: DataFrame, hot: int = HOT, digests: bool = False) -> DataFrame:
    """Remove every byte of ``docs`` that a 400-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept, the bytes left (with ``digests`` their
    SHA-256 as kept_sha256, which spares a shuffle of all texts), and n_passages, for every row. n_passages counts the
    maximal runs of over 50 words, made of strings of 250 bytes, or of 51 words in fewer bytes, that another document
    has too; those shorter than 400 bytes are counted, not removed. Strings are judged on the input, overlaps count,
    and no string crosses texts. A null text counts as empty; a text under 400 bytes is never touched; of repeated rows or equal texts of 400 bytes
    or more nothing is left, and rows equal in doc_id and text count as one document for passages; an empty table
    gives an empty result; extra columns are ignored. Rows are told apart by doc_id and 64 bits of hash of the text,
    contents of one anchor by 64 bits of hash; windows that share three anchors with too many others by 128 bits.
    """
    found = removals(docs, hot).withColumnRenamed("doc", "_doc").withColumnRenamed("key", "_key")
    value = (lambda c: F.sha2(c, 256)) if digests else (lambda c: F.col(c))
    name = "kept_sha256" if digests else "kept"
    rows = named(docs).select("doc", "key", F.octet_length("bytes").cast("long").alias("n_bytes"), value("bytes").alias("own"))
    own = rows.join(found.withColumn("kept", value("kept")), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.select(F.col("doc").alias("doc_id"), "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept", "own").alias(name), count("n_passages"))


def remove_passages_from_texts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` without passages that repeat across documents: the text is what is left, n_chars is set anew.

    A passage is a maximal run of over 50 words that another document has too, byte by byte, made of strings of 250
    bytes or, where 51 words have fewer, of 51 words; broken characters at the seams go with it. Documents of which
    nothing is left are dropped; those that came without text stay as they are, as does every text without such a
    passage, those of up to 50 words included. Rows equal in doc_id and text count as one document. An empty table gives an empty
    result; columns of any other name are carried through.
    """
    spans = by_row(repeated_spans(whole_texts(docs), PASSAGE, hot, words=True)[0].where("across"))
    found = named(docs).where(F.octet_length("bytes") >= SHORTEST).join(spans.hint("shuffle_hash"), _same_row(), "left").select("row", F.col("bytes").alias("text"), "spans")
    cut = cut_texts(found, Spans.passages).where("octet_length(kept) > 0")
    left = F.col("kept").cast("string")
    valid = F.when(F.col("n_removed") == 0, left).otherwise(F.coalesce(F.try_validate_utf8(left), F.make_valid_utf8(left)))
    found = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": valid}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") == 0, found["n_chars"]).otherwise(F.char_length(valid))
        found["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    cut = cut.select(*(found[c].alias(c) for c in docs.columns))
    short = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) < SHORTEST)
    return cut.unionByName(short)
