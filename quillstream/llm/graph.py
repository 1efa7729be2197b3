"""Connected components of a link table, by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TASK_ROWS, sized, stored


def looked_up(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join that is sent to all tasks if one task could hold it."""
    return F.broadcast(df) if rows <= TASK_ROWS else df


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); nodes of one component share the root.

    Each round every node moves to the neighbour (or itself) whose hash, drawn anew by round, is least; the links
    between the places moved to are the next, smaller graph. Rounds grow with the logarithm of the nodes, as
    chains are broken by the hashes. The round's moves are stored and followed backwards at the end. Every round takes
    as many tasks as its links need.
    """
    found = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stored(sized(found.distinct(), found.count()))
    moves: list[tuple[DataFrame, int]] = []
    while count := links.count():
        seed = F.lit(len(moves))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("node", seed).alias("h"), F.col("node").alias("to"))
        moved = stored(sized(near.select("node", F.least(own, "m")["to"].alias("to")), 2 * count))
        moves.append((moved, moved.count()))
        left, right = moved.select(F.col("node").alias("a"), F.col("to").alias("x")), moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        joined = links.join(looked_up(left, moves[-1][1]), "a").join(looked_up(right, moves[-1][1]), "b").where("x <> y")
        links = stored(sized(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), count))
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots, count = moves[-1][0].select("node", F.col("to").alias("root")), moves[-1][1]
    for moved, nodes in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("later"))
        roots, count = moved.join(looked_up(later, count), "to", "left").select("node", F.coalesce("later", "to").alias("root")), nodes
    return stored(sized(roots, count))
