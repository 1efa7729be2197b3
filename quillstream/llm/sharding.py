"""Reproducible sharding: a keyed Feistel permutation of global row numbers (DataFrame functions only)."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LAW = "rows"
ROUNDS = 4


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _round(value: Column, round_no: int, key: int, modulus: int) -> Column:
    """Round function: the first 48 bits of an md5, reduced to ``modulus``."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{key}"), F.lit(f"{round_no}"), value.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), _long(modulus))


def feistel(value: Column, left: int, right: int, key: int) -> Column:
    """Permute ``value`` in 0 .. left*right-1 by a Feistel network over Z_left x Z_right."""
    b = F.pmod(value, _long(right))
    a = ((value - b) / _long(right)).cast("long")
    for r in range(ROUNDS):
        if r % 2 == 0:
            a = F.pmod(a + _round(b, r, key, left), _long(left))
        else:
            b = F.pmod(b + _round(a, r, key, right), _long(right))
    return a * _long(right) + b


def permuted(value: Column, n: int, key: int) -> Column:
    """A permutation of 0 .. n-1: the network over the next rectangle, walked until it lands below ``n``.

    A walk leaves the range at most as often as there are numbers at or over ``n`` (under sqrt(n)), so that
    many further steps always suffice; they are evaluated only for the rows that need them.
    """
    right = isqrt(max(n - 1, 0)) + 1
    left = max(1, -(-n // right))
    first = feistel(value, left, right, key)
    spare = left * right - n
    if not spare:
        return first
    walked = F.aggregate(
        F.sequence(_long(1), _long(spare)),
        first,
        lambda x, _: F.when(x < _long(n), x).otherwise(feistel(x, left, right, key)),
    )
    return F.when(first < _long(n), first).otherwise(walked)


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with gapless row numbers from 0 in the given order, and the number of rows.

    One range shuffle; the numbers of a partition start at the sum of the counts before it (one small row a
    partition). Rows that tie in every ordering column may swap numbers, so order by all that is returned.
    """
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = df.repartitionByRange(*[F.col(c) for c in order], F.col("_tie")).sortWithinPartitions(*order, "_tie")
    placed = stored(
        ranged.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int"))
        .withColumn("_within", F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at", "_tie")
    )
    counts = placed.groupBy("_part").count().orderBy("_part").collect()
    starts, total = [], 0
    for part in counts:
        starts.append((part["_part"], total))
        total += part["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_within", "_start"), total


def shard_documents(docs: DataFrame, shards: int = 8, key: int = 20240229) -> DataFrame:
    """Put every row into one of ``shards`` shards, whose row counts differ by one at most.

    Rows are numbered by (doc_id, crc32 of the text, size), the number is permuted, and position p goes to
    shard ``p mod shards``, slot ``p div shards``: both can be computed from the row number alone.
    A null text has size 1 and crc32 0; null ids come first; equal rows get neighbouring numbers. An empty
    table gives an empty result. Only ids and sizes are shuffled, never texts. Extra columns are ignored.
    """
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    place = rows.withColumn("_place", permuted(F.col("row_number"), n, key))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.pmod("_place", _long(shards)).cast("int").alias("shard"),
        ((F.col("_place") - F.pmod("_place", _long(shards))) / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
