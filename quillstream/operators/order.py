"""Exact ranks and order statistics without sorting a group in one task.

Rows are dealt out by ranges of group, value and ties, so that a large group, and within it a value that many rows share, lies
in many tasks; ranks inside a range and the rows before it give the rank (see ``scan``). Order statistics are read off
counts by value, added up before they are shuffled, so equal values cost one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def ranked(df: DataFrame, group: list[str], key: Column, ties: list[Column], keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``df`` with rank (from 1, by key and ties, ascending) and _n, the size of the group; rows without a key go.

    ``keep(rank, n)`` says which ranks are wanted, all up to one of them or all from one on; ranges without any are left
    out before rows are ranked.
    """
    order = ["_key", "_ties"]
    keyed = df.withColumn("_key", key).withColumn("_ties", F.struct(*ties) if ties else F.lit(0)).where("_key IS NOT NULL")
    rows = scan.segmented(keyed, group, order)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    placed = scan.carried(
        rows, group, {"c": F.count("*")},
        lambda _, before: {"_before": F.coalesce(F.sum("c").over(before), F.lit(0)), "_n": F.sum("c").over(whole), "_c": F.col("c")},
    )
    if keep is not None:
        placed = placed.where(keep(F.col("_before") + 1, F.col("_n")) | keep(F.col("_before") + F.col("_c"), F.col("_n")))
    found = placed.withColumn("rank", (F.row_number().over(scan.inside(group, order)) + F.col("_before")).cast("int"))
    found = found if keep is None else found.where(keep(F.col("rank"), F.col("_n")))
    return found.select(*df.columns, "rank", "_n")


def counted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The different values of each group with _c (rows), _upto (rows up to and with it) and _n (rows of the group)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    rows = scan.running_sums(scan.segmented(counts, group, [value]), group, [value], {"_upto": F.col("_c")})
    sizes = rows.groupBy(*[F.col(g).alias(f"_g{g}") for g in group]).agg(F.sum("_c").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{g}")) for g in group], F.lit(True))
    joined = rows.join(sizes, same) if group else rows.crossJoin(F.broadcast(sizes))
    return joined.select(*group, value, "_c", "_upto", "_n")


def values_at(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row with the values at some ranks (from 1, as functions of the number of values), by name."""
    counts = counted(df.select(value), [], value)
    here = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)
    return counts.agg(*[F.max(F.when(here(rank(F.col("_n")).cast("long")), F.col(value))).alias(name) for name, rank in ranks.items()])
