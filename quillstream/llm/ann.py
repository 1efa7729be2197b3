"""Approximate nearest neighbours: a navigable small-world graph per shard in flat arrays, shard results merged."""

from __future__ import annotations

import io
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: Distinct vectors of a shard, and queries that are searched for at a time.
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
#: Links of a node above the base layer (twice as many in it), and the beams of building, of searching, and of both above it.
LINKS, BUILD_BEAM, SEARCH_BEAM, UPPER_BEAM = 16, 64, 256, 48
#: Beam members opened in one step, rows that are inserted or searched together, and rows linked by brute force first.
OPENED, TOGETHER, FIRST = 4, 256, 128
MODULUS, NEAREST = 20, 20


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component, which makes all norms equal: nearness by inner product becomes nearness by angle."""
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)


def best_first(sims: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (sims, *arrays))


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and similarities of the ``beam`` best nodes found for each query, best first.

    ``entry`` has the nodes to start from, a row a query (-1: none). All queries walk in lockstep: a step opens the best unopened members of every beam that can still gain.
    """
    n = len(queries)
    seen = np.zeros((n, len(points)), bool)
    ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    entry = entry[:, :beam]
    given = entry >= 0
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(given, np.einsum("qed,qd->qe", points[np.maximum(entry, 0)], queries), -np.inf)
    opened[:, : entry.shape[1]] = ~given
    seen[np.nonzero(given)[0], entry[given]] = True
    active = np.arange(n)
    while active.size:
        waiting = np.where(opened[active], -np.inf, sims[active])
        top = np.argsort(-waiting, axis=1)[:, :OPENED]
        value = np.take_along_axis(waiting, top, 1)
        going = value[:, 0] > -np.inf
        active, top, value = active[going], top[going], value[going]
        if not active.size:
            break
        row = active[:, None]
        nodes = np.where(value > -np.inf, ids[row, top], -1)
        opened[row, top] = True
        found = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(active.size, -1)
        fresh = (found >= 0) & ~seen[row, found]
        # a node may be reached twice in one step: only its first place counts
        order = np.argsort(found, axis=1, kind="stable")
        ranked = np.take_along_axis(found, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        at, col = np.nonzero(fresh)
        seen[active[at], found[at, col]] = True
        gained = np.full(found.shape, -np.inf, np.float32)
        gained[at, col] = np.einsum("nd,nd->n", points[found[at, col]], queries[active[at]])
        all_sims = np.concatenate([sims[active], gained], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], found], axis=1), keep, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], axis=1), keep, 1)
    ids[sims == -np.inf] = -1
    sims, ids = best_first(sims, ids)
    return ids, sims


def diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, best first, those nearer to the row than to any chosen before; then the nearest others."""
    vectors = points[np.maximum(ids, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        closest = np.where(chosen, between[:, c, :], -np.inf).max(axis=1)
        chosen[:, c] = (ids[:, c] >= 0) & (chosen.sum(axis=1) < most) & (sims[:, c] > closest)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def connect(points: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Link the nodes ``new`` to diverse candidates and back; full lists are chosen anew."""
    most = links.shape[1]
    links[new] = diverse(points, ids, sims, most)
    source, target = np.repeat(new, most), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    added = np.full((nodes.size, int(counts.max(initial=0))), -1, np.int64)
    added[np.repeat(np.arange(nodes.size), counts), np.arange(target.size) - np.repeat(first, counts)] = source
    for at in range(0, nodes.size, 1024):
        some = nodes[at : at + 1024]
        pool = np.concatenate([links[some], added[at : at + 1024]], axis=1)
        order = np.argsort(pool, axis=1, kind="stable")
        ranked = np.take_along_axis(pool, order, 1)
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
        near = np.einsum("ncd,nd->nc", points[np.maximum(ranked, 0)], points[some])
        near[ranked < 0] = -np.inf
        near, ranked = best_first(near, ranked)
        links[some] = diverse(points, ranked, near, most)


def build_graph(points: np.ndarray, seed: int = 8) -> list[np.ndarray]:
    """Neighbour arrays from the base layer up, and as the last item the entry node.

    Nodes get their layers at random; they are inserted in growing batches, each of which finds its neighbours in
    the graph of those before it and, by brute force, among itself.
    """
    n, rng = len(points), np.random.default_rng(seed)
    level = np.floor(-np.log(1.0 - rng.random(n)) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")  # the highest come first, so that every layer has its entry
    order[1:] = np.concatenate([order[1:FIRST][np.argsort(rng.random(len(order[1:FIRST])))], rng.permutation(order[FIRST:])])
    tops = int(level.max(initial=0)) + 1
    layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int64) for k in range(tops)]
    entry, done = int(order[0]), 0
    while done < n:
        size = FIRST if done == 0 else min(TOGETHER, done)
        new = order[done : done + size]
        at = np.full((new.size, 1), entry)
        for k in range(tops - 1, -1, -1):
            if done:
                ids, sims = beam_search(points, layers[k], points[new], at, BUILD_BEAM if k == 0 else UPPER_BEAM)
                at = ids
            members = new[level[new] >= k]
            if not members.size:
                continue
            mine = points[members] @ points[members].T
            np.fill_diagonal(mine, -np.inf)
            own = np.broadcast_to(members, mine.shape)
            if done:
                rows = level[new] >= k
                mine, own = np.concatenate([sims[rows], mine], axis=1), np.concatenate([ids[rows], own], axis=1)
            mine, own = best_first(mine, own)
            own = np.where(mine == -np.inf, -1, own)[:, :BUILD_BEAM]
            connect(points, layers[k], members, own, mine[:, :BUILD_BEAM])
        done += new.size
    return [*layers, np.array([entry])]


def search_graph(points: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Ids (-1: none) of the best nodes found for each query.

    Each layer starts from all that the beam of the layer above has found, so that a query whose nearest node up there
    lies in another cluster than its neighbours still reaches them.
    """
    out = []
    for start in range(0, len(queries), TOGETHER):
        part = queries[start : start + TOGETHER]
        at = np.full((len(part), 1), int(graph[-1][0]))
        for k in range(len(graph) - 2, 0, -1):
            at, _ = beam_search(points, graph[k], part, at, UPPER_BEAM)
        out.append(beam_search(points, graph[0], part, at, beam)[0])
    return np.concatenate(out) if out else np.zeros((0, beam), np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    )


def nearest(vectors: DataFrame, modulus: int = MODULUS, k: int = NEAREST) -> DataFrame:
    """The ``k`` nearest other rows of every row whose vec_id is divisible by ``modulus``, by inner product.

    Returns query_id, rank, vec_id and score, the exact inner product in double precision; ties go to the smaller
    vec_id. Rows without id, vector or norm, or with a null or non-finite component take no part; repeated rows
    count once; vectors only meet those of their own length; an empty table gives an empty result. Equal vectors
    are one node, with the k + 1 smallest ids, which are all that can be among k nearest. Every shard holds
    SHARD_ROWS distinct vectors or fewer, on average, and answers every query; recall depends on SEARCH_BEAM. A shard's
    graph goes to one task, which its queries stream through.
    """
    rows = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1)
    nodes = stored(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, ceil(nodes.count() / SHARD_ROWS))
    keyed = nodes.withColumn("shard", F.concat_ws(":", F.size("embedding"), F.pmod(F.xxhash64("embedding"), F.lit(shards))))

    def build(table: pa.Table) -> pa.Table:
        size = len(table.column("embedding")[0])
        original = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        ids = np.full((table.num_rows, k + 1), -1, np.int64)
        for row, found in enumerate(table.column("ids").to_pylist()):
            ids[row, : len(found)] = found
        graph = build_graph(lifted(original))
        file = io.BytesIO()
        np.savez(file, original=original.astype(np.float64), ids=ids, **{f"g{i:03d}": x for i, x in enumerate(graph)})
        return pa.table({"shard": table.column("shard")[:1], "graph": pa.array([file.getvalue()], pa.binary())})

    graphs = stored(keyed.groupBy("shard").applyInArrow(build, "shard string, graph binary"))
    queries = stored(rows.where(F.pmod("vec_id", F.lit(modulus)) == 0))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.withColumn("_s", numbers).select(F.concat_ws(":", F.size("embedding"), "_s").alias("shard"), "vec_id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its graph before its queries, which are answered as they stream by."""
        current, loaded = None, None
        for batch in batches:
            names, graph, number = (batch.column(c) for c in ("shard", "graph", "vec_id"))
            marks = list(zip(names.to_pylist(), graph.is_valid().to_pylist(), strict=True))
            cuts = [k for k in range(len(marks)) if not k or marks[k] != marks[k - 1]]
            for at, end in zip(cuts, [*cuts[1:], len(marks)], strict=True):
                if marks[at][1]:
                    current = marks[at][0]
                    with np.load(io.BytesIO(graph[at].as_py())) as file:
                        layers = [file[name] for name in sorted(file.files) if name.startswith("g")]
                        loaded = file["original"], file["ids"], lifted(file["original"]), layers
                elif marks[at][0] == current:
                    for start in range(at, end, QUERY_ROWS):
                        part = batch.slice(start, min(end, start + QUERY_ROWS) - start)
                        vectors = np.array(part.column("embedding").to_pylist(), np.float64)
                        yield answered(part.column("vec_id").to_numpy(), vectors, *loaded)

    def answered(numbers: np.ndarray, vectors: np.ndarray, original: np.ndarray, ids: np.ndarray, points: np.ndarray, graph: list) -> pa.RecordBatch:
        found = search_graph(points, graph, np.pad(vectors, ((0, 0), (0, 1))).astype(np.float32), SEARCH_BEAM)
        out = []
        for query, vector, nodes in zip(numbers.tolist(), vectors, found, strict=True):
            nodes = nodes[nodes >= 0]
            score, member = np.repeat(original[nodes] @ vector, ids.shape[1]), ids[nodes].ravel()
            real = (member >= 0) & (member != query)
            member, score = member[real], score[real]
            best = np.lexsort((member, -score))[:k]
            out.append((np.full(best.size, query), member[best], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    none = F.lit(None)
    both = graphs.select("shard", "graph", none.cast("long").alias("vec_id"), none.cast(rows.schema["embedding"].dataType).alias("embedding"))
    both = both.unionByName(asked.withColumn("graph", none.cast("binary")))
    tasks = max(partitions(vectors.sparkSession), shards)
    dealt = both.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("graph").isNull(), "vec_id")
    hits = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
