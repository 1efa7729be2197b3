"""Salience of text segments: weighted pattern families, neighbour bonus, distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import HEURISTICS
from ..functions.text import Searched, guarded, python_regex, total
from .order import values_at

THRESHOLD, TO_PREVIOUS, TO_NEXT = 3.0, 0.3, 0.15


def heuristics(name: str = "user") -> list[tuple[str, float, list[str]]]:
    """The pattern families, with a user's name filled in."""
    return [(family, weight, [p.replace("{name}", name.lower()) for p in patterns]) for family, weight, patterns in HEURISTICS]


def heuristic(name: str, user: str = "user") -> tuple[str, float, list[str]]:
    """One pattern family by its name; raises KeyError for an unknown one."""
    return {family: (family, weight, patterns) for family, weight, patterns in heuristics(user)}[name]


def family_scores(text: Column, families: list[tuple[str, float, list[str]]], linear: bool = True) -> dict[str, Column]:
    """Score of each family in a lower-case text: weight * (1 + (m - 1) / 2) for m patterns found, or weight * m if not ``linear``."""
    low, out = text, {}
    for family, weight, patterns in families:
        m = total([guarded(low, p, F.regexp_like(low, python_regex(p)).cast("int")) for p in patterns])
        out[family] = F.when(m > 0, weight * (1 + 0.5 * (m - 1)) if linear else weight * m).otherwise(0.0)
    return out


def with_salience(df: DataFrame, text: str = "text", families: list | None = None) -> DataFrame:
    """Add one column ``h_<family>`` each and salience, their sum."""
    families, low, seen = heuristics() if families is None else families, F.col("_low"), Searched("_has")
    found = {p: guarded(seen, p, F.regexp_like(low, python_regex(p)).cast("int")) for _, _, patterns in families for p in patterns}
    return summed(df.withColumn("_low", F.lower(text)).withColumn("_has", seen.flags(low)), families, found).drop("_low", "_has")


def summed(df: DataFrame, families: list[tuple[str, float, list[str]]], each: dict[str, Column]) -> DataFrame:
    """Add ``h_<family>`` and salience, given 1 or 0 for each pattern."""
    # the patterns found are columns of their own, as a score mentions their number more than once
    found = {f"_m_{k}": total([each[p] for p in patterns]) for k, _, patterns in families}
    scores = {f"h_{k}": F.when(F.col(f"_m_{k}") > 0, weight * (1 + 0.5 * (F.col(f"_m_{k}") - 1))).otherwise(0.0) for k, weight, _ in families}
    return df.withColumns(found).withColumns(scores).withColumn("salience", F.round(total([F.col(k) for k in scores]), 6)).drop(*found)


def with_context_bonus(df: DataFrame, document: str, order: str) -> DataFrame:
    """Add context_bonus and combined: strong segments (over 3) lift the one before by 0.3 and after by 0.15 of theirs."""
    by_document = Window.partitionBy(document).orderBy(order)
    strong = F.when(F.col("salience") > THRESHOLD, F.col("salience")).otherwise(0.0)
    marked = df.withColumn("_strong", strong)
    bonus = TO_PREVIOUS * F.coalesce(F.lead("_strong").over(by_document), F.lit(0.0)) + TO_NEXT * F.coalesce(F.lag("_strong").over(by_document), F.lit(0.0))
    return marked.withColumn("context_bonus", F.round(bonus, 6)).withColumn("combined", F.round(F.col("salience") + F.col("context_bonus"), 6)).drop("_strong")


def distribution(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min, max, mean, sample deviation and the values at floor(n * p) for p10 ... p99."""
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}

    def rank(p: float) -> Callable[[Column], Column]:
        return lambda n: F.when((F.lit(p) == 0.99) & (n < 100), n).otherwise(F.floor(n * p) + 1)

    plain = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 5).alias("stdev"))
    return plain.crossJoin(F.broadcast(values_at(df, value, {name: rank(p) for name, p in points.items()})))


def bucket(value: Column) -> Column:
    return F.when(value == 0, "zero").when(value < 2, "low").when(value < 4, "medium").otherwise("high")
