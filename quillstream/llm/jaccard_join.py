"""N-gram Jaccard join: chosen paths over minimum-hash sketches, exact verification, classes and link counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestream import in_chunks
from .common import partitions, sized, stored, text_key
from .graph import connected, looked_up
from .shingles import COORDINATES, mixed, shingles, sketches

#: Similarity to reach, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Independent runs, and splits of every run before buckets are looked at. A node of the recursion keeps each
#: sketch coordinate with probability 1 / (similarity * COORDINATES), so that a pair at the threshold stays
#: together in one child on average. One run joins such a pair with probability 0.47 after two splits; all
#: RUNS miss it with probability 4e-5, and pairs over the threshold less often. After MOST_SPLITS splits one run joins
#: it with probability 0.31 only: rows left in a bucket over LARGE go through RUNS more runs among themselves, after
#: which a pair of them is missed with probability 5e-5.
RUNS, SPLITS, MOST_SPLITS = 16, 2, 4
#: Runs whose links are followed to groups first; the other runs only report links between different groups.
FIRST_RUNS = 4
#: Rows of a bucket that are compared in one task. Larger buckets meet in parts of about this size; what no other row
#: of its part stands for meets again, and is split further if it is still more.
LARGE = 1024
#: Share of equal sketch coordinates that makes a candidate, and that lets one row stand for another.
CANDIDATE, ABSORBED = 0.6, 0.9
#: Texts of a component that are compared at a time; larger components go block against block.
BLOCK = 256
CHUNK = 2_000_000
#: Rows of buckets that one task compares, about.
GROUP_ROWS = 4 * LARGE


def children(paths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths one level down: all rows of a path keep the same coordinates and part by their values."""
    c = np.arange(COORDINATES, dtype=np.uint64)
    drawn = mixed(paths[:, None] + (c + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15))
    least = np.uint64(int(2**64 * DENOMINATOR / (NUMERATOR * COORDINATES)))
    row, coordinate = np.nonzero(drawn < least)
    value = sketch[row, coordinate].astype(np.uint64)
    return row, mixed(drawn[row, coordinate] ^ mixed(value + np.uint64(0x632BE59BD9B4E019)))


def root_paths(sketch: np.ndarray, first: int = 1, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of some runs, numbered from ``first``, after SPLITS splits."""
    row = np.repeat(np.arange(len(sketch)), runs)
    path = np.tile(mixed(np.arange(first, first + runs, dtype=np.uint64)), len(sketch))
    for _ in range(SPLITS):
        part, path = children(path, sketch[row])
        row = row[part]
    return row, path


class Forest:
    """Union-find over positions, for the links inside one bucket."""

    def __init__(self, n: int, groups: np.ndarray | None = None) -> None:
        self.up = list(range(n))
        if groups is not None:  # positions of one group are linked from the start
            self.up = np.unique(groups, return_index=True)[1][np.unique(groups, return_inverse=True)[1]].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def bucket_links(codes: np.ndarray, groups: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that span the candidates of one bucket (known groups count as linked), and its leaders, for which absorbed
    rows need not stand."""
    forest, links, leaders = Forest(len(codes), groups), [], np.zeros(0, np.int64)

    def link(i: int, j: int) -> None:
        if forest.join(i, j):
            links.append((i, j))

    for start in range(0, len(codes), BLOCK):
        block = np.arange(start, min(len(codes), start + BLOCK))
        if leaders.size:
            free = np.ones(block.size, bool)
            for part in range(0, leaders.size, BLOCK):
                some = leaders[part : part + BLOCK]
                same = (codes[block][:, None] == codes[some][None]).mean(axis=2)
                for i, j in zip(*np.nonzero(same >= CANDIDATE), strict=True):
                    link(int(some[j]), int(block[i]))
                free &= same.max(axis=1) < ABSORBED
            block = block[free]
        same = (codes[block][:, None] == codes[block][None]).mean(axis=2)
        kept = np.ones(block.size, bool)
        for i, j in zip(*np.nonzero(np.triu(same >= CANDIDATE, 1)), strict=True):
            link(int(block[i]), int(block[j]))
            if kept[i] and same[i, j] >= ABSORBED:
                kept[j] = False
        leaders = np.concatenate([leaders, block[kept]])
    return links, leaders.tolist()


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, as tables; a run that ends a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and any(waiting[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(waiting)
            waiting = []
        cuts = [0, *changes(batch).tolist(), batch.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if at and waiting:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(at, end - at))
    if waiting:
        yield pa.Table.from_batches(waiting)


def sorted_groups(df: DataFrame, keys: list[str], run: Callable, schema: str, rows: int | None = None) -> DataFrame:
    """Hash-partition and sort by ``keys`` and stream each partition through ``run``; ``rows``: about so many narrow ones."""
    dealt = df.repartition(partitions(df.sparkSession), *keys)
    return (dealt if rows is None else sized(dealt, rows, GROUP_ROWS)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, whether it has words, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in in_chunks(texts, CHUNK):
                hashes, bounds = shingles(texts[start:end])
                rows = [x.tobytes() for x in sketches(hashes, bounds)]
                columns = [batch.column("doc_id")[start:end], batch.column("key")[start:end]]
                columns += [pa.array(np.diff(bounds) > 0), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "worded", "sketch"])

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text).mapInArrow(
        run, "doc_id long, key binary, worded boolean, sketch binary"
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, COORDINATES)


def candidate_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) that span groups of texts with like sketches; texts: id, sketch. Repeats are possible.

    The first runs already join most of a group; the others only report what joins different groups, so that a text
    with many near copies is not reported once more by every run.
    """
    groups = connected(links_of_runs(texts, 1, FIRST_RUNS, texts.select("id", F.col("id").alias("group"))))
    known = texts.select("id").join(looked_up(groups, groups.count()), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("group"))
    more = links_of_runs(texts, FIRST_RUNS + 1, RUNS - FIRST_RUNS, known)
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)


def links_of_runs(texts: DataFrame, first_run: int, runs: int, groups: DataFrame) -> DataFrame:
    """Links (a, b) of some runs that join different groups of the texts (id, group)."""

    def roots(first: int, runs: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    row, path = root_paths(_matrix(part.column("sketch"), np.uint32), first, runs)
                    ids = part.column("id").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(path.view(np.int64))], ["id", "path"])

        return run

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                row, path = children(part.column("path").to_numpy().view(np.uint64), _matrix(part.column("sketch"), np.uint32))
                ids = part.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(path.view(np.int64))], ["id", "path"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["path", "salt"]):
            if group.num_rows < 2 and group.column("parts")[0].as_py() < 2:
                continue
            ids, codes = group.column("id").to_numpy(), _matrix(group.column("code"), np.uint8)
            links, leaders = bucket_links(codes, group.column("group").to_numpy())
            a, b = [int(ids[i]) for i, _ in links], [int(ids[j]) for _, j in links]
            path = [None] * len(a)
            if group.column("parts")[0].as_py() > 1:
                a, b = a + [int(ids[i]) for i in leaders], b + [None] * len(leaders)
                path += [group.column("path")[0].as_py()] * len(leaders)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(path, pa.int64())], ["a", "b", "path"])

    def faced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["path", "low", "high"]):
            ids, block, codes = group.column("id").to_numpy(), group.column("block").to_numpy(), _matrix(group.column("code"), np.uint8)
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            own, other = np.flatnonzero(block == low), np.flatnonzero(block == high)
            forest, a, b = Forest(ids.size, group.column("group").to_numpy()), [], []
            for start in range(0, own.size, BLOCK):
                some = own[start : start + BLOCK]
                for part in range(0, other.size, BLOCK):
                    most = other[part : part + BLOCK]
                    same = (codes[some][:, None] == codes[most][None]).mean(axis=2)
                    for i, j in zip(*np.nonzero(same >= CANDIDATE), strict=True):
                        if forest.join(int(some[i]), int(most[j])):
                            a.append(int(ids[some[i]]))
                            b.append(int(ids[most[j]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "path"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = _matrix(batch.column("sketch"), np.uint32).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "code"])

    n_texts = texts.count()
    codes = stored(sized(texts.select("id", "sketch").mapInArrow(coded, "id long, code binary").join(groups, "id"), n_texts))
    sources, schema = texts.select("id", "sketch"), "a long, b long, path long"

    def shared(rows: DataFrame) -> DataFrame:
        """The rows of paths that two or more have, with how many."""
        all_rows = rows.count()
        counts = stored(sized(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), all_rows))
        return stored(sized(rows.join(looked_up(counts, counts.count()), "path").select("path", "id", "n"), all_rows))

    def met(buckets: DataFrame, rows: int) -> DataFrame:
        """Links inside buckets or their parts, and the leaders of parts, as rows without b."""
        parts = F.ceil(F.col("n") / LARGE)
        salted = buckets.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")))
        dealt = sized(salted.join(codes, "id").select("path", "salt", "parts", "id", "code", "group"), max(rows, n_texts))
        return stored(sorted_groups(dealt, ["path", "salt"], linked, schema, rows))

    def block_by_block(buckets: DataFrame) -> DataFrame:
        """Links of buckets that stay large, each block of rows with each other: quadratic in what is left of them."""
        blocks = F.ceil(F.col("n") / LARGE)
        placed = buckets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(codes, "id")
        dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
            "path", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "id", "code", "group"
        )
        return stored(sorted_groups(dealt, ["path", "low", "high"], faced, schema))

    found = []
    rows = stored(sources.mapInArrow(roots(first_run, runs), "id long, path long"))
    for split in range(SPLITS, MOST_SPLITS + 1):
        both = shared(rows)
        found.append(met(both, both.count()))
        leaders = found[-1].where("b IS NULL").select("path", F.col("a").alias("id"))
        if not leaders.limit(1).count():
            break
        left = shared(leaders)
        large = left.where(F.col("n") > LARGE)
        n_left, n_large = left.count(), large.count()
        if n_left > n_large:
            found.append(met(left.where(F.col("n") <= LARGE), n_left - n_large))
        if not n_large:
            break
        if split == MOST_SPLITS:
            found.append(block_by_block(large))
            break
        rows = large.join(sources, "id").select("id", "path", "sketch").mapInArrow(deeper, "id long, path long")
        if split == SPLITS:
            again = sources.join(large.select("id").distinct(), "id", "left_semi").select("id", "sketch")
            rows = rows.unionByName(again.mapInArrow(roots(RUNS + first_run, runs), "id long, path long"))
        rows = stored(sized(rows, n_large, GROUP_ROWS))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.where("b IS NOT NULL").select("a", "b")


def verified(members: DataFrame) -> DataFrame:
    """Exact similarity of the texts of each component: (id, links, other) rows.

    members: component, blocks, block, id, text. ``links`` counts the texts of the other block (or the same) that
    reach the similarity; a row with ``other`` is one link of a set that spans them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, ["component", "low", "high"]):
            ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
            hashes, bounds = shingles(group.column("text").to_pylist())
            owner = np.repeat(np.arange(ids.size), np.diff(bounds))
            pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)], axis=1), axis=0)
            value, owner = np.unique(pairs[:, 0], return_inverse=True)[1], pairs[:, 1].astype(np.int64)
            sizes = np.bincount(owner, minlength=ids.size)
            frequent = np.bincount(value) > 1
            value, owner = (np.cumsum(frequent) - 1)[value[frequent[value]]], owner[frequent[value]]
            shared = np.zeros((ids.size, ids.size), np.float32)
            for at in range(0, int(frequent.sum()), 4096):
                inside = (value >= at) & (value < at + 4096)
                dense = np.zeros((ids.size, 4096), np.float32)
                dense[owner[inside], value[inside] - at] = 1
                shared += dense @ dense.T
            either = sizes[:, None] + sizes[None, :] - shared
            near = (DENOMINATOR * shared >= NUMERATOR * either) & (sizes > 0)[:, None] & (sizes > 0)[None, :]
            np.fill_diagonal(near, False)
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
            if low != high:
                near &= block[:, None] != block[None, :]
            forest, a, b = Forest(ids.size), [], []
            for i, j in zip(*np.nonzero(np.triu(near)), strict=True):
                if forest.join(int(i), int(j)):
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
            columns = [pa.array([*ids.tolist(), *a], pa.int64()), pa.array([*near.sum(axis=1).tolist(), *[0] * len(a)], pa.int64())]
            columns.append(pa.array([*[None] * ids.size, *b], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "links", "other"])

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = members.withColumn("_other", other).select(
        "component", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "id", "text"
    )
    return sorted_groups(dealt, ["component", "low", "high"], run, "id long, links long, other long")


def classes_of_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with the key of their text, and per distinct text: key, first (least doc_id), copies, n_links,
    class_id (least doc_id of the class) and keeper (whether the class's least doc_id has this text)."""
    rows = stored(sketched(docs))
    distinct = rows.groupBy("key").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("worded").alias("worded"), F.any_value("sketch").alias("sketch")
    )
    texts = stored(distinct.withColumn("id", F.monotonically_increasing_id()))
    groups = connected(candidate_links(texts.where("worded")))
    sized = groups.groupBy("root").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    members = groups.join(sized, "root").select(
        F.col("root").alias("component"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.col("node").alias("id")
    )
    wanted = texts.join(members, "id").select("key", "first", "component", "blocks", "block", "id")
    whole = docs.select(text_key().alias("key"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = whole.join(wanted, (whole["key"] == wanted["key"]) & whole["doc_id"].eqNullSafe(wanted["first"])).drop(whole["key"])
    checked = stored(verified(found.dropDuplicates(["id"])))
    links = checked.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("n_links"))
    exact = connected(checked.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = texts.join(exact.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).join(links, "id", "left")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "id")).alias("least"))
    judged = named.join(least, "root").select(
        "key", "first", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("least.first").alias("class_id"), (F.col("id") == F.col("least.id")).alias("keeper"),
    )
    return rows.select("doc_id", "key"), stored(judged)


def join_near_texts(docs: DataFrame) -> DataFrame:
    """Classes of documents linked by word shingles: doc_id, class_id, n_links and copies for every row.

    Two different texts are linked when the sets of their five-word shingles have a Jaccard similarity of 4/5 or
    more; n_links counts a text's linked other texts, copies the rows with this very text (itself included), and
    class_id is the least doc_id of all documents connected by links and equal texts. A text of one to four words
    has one shingle; null, empty and blank texts have none and are linked to nothing, a null counting as the empty
    text. Repeated rows share their class; rows without any id in their class get a null class_id. An empty table
    gives an empty result; extra columns are ignored. Candidates come from chosen paths (links may be missed with
    the probability stated at RUNS), every reported link is exact.
    """
    rows, texts = classes_of_texts(docs)
    return rows.join(texts, "key").select("doc_id", "class_id", "n_links", "copies")


def keep_one_of_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every class: the one with the least doc_id, and one of equal such rows.

    Texts that are null, empty or blank are linked to nothing; a null counts as the empty text, so one row stays of
    all of these. An empty table gives an empty result; columns of any other name are carried through.
    """
    _, texts = classes_of_texts(docs)
    kept = texts.where("keeper").select(F.col("key").alias("kept"), "first")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("key"), F.col("doc_id").cast("long").alias("doc"))
    joined = keyed.join(kept, (F.col("key") == F.col("kept")) & F.col("doc").eqNullSafe(F.col("first")))
    return joined.dropDuplicates(["key"]).select("row.*")
