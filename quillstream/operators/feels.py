"""The feels score of a chunk, its components, and order statistics by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import Searched, hits, population_deviation
from .order import counted

# The tags that change the score, and the caps of two of its parts.
CLOSED, META, AFFECT = "resolution / closure", "meta-commentary", "affectively loaded / emotional"
VARIANCE_CAP, RESISTANCE_CAP = 1.2, 4.0


def sentence_lengths(low: Column) -> Column:
    """Words of each sentence of more than two."""
    return F.filter(F.transform(F.split(low, r"(?U)[.!?]\s+"), lambda s: F.regexp_count(s, F.lit(r"(?U)\S+"))), lambda n: n > 2)


def feels_parts(low: Column | Searched, tags: Column, lengths: Column) -> dict[str, Column]:
    """The parts that add up to the unweighted score of a lower-case text; 0 where one does not apply."""
    has = lambda tag: F.array_contains(tags, tag)
    uncertain, closing = hits(low, L.UNCERTAINTY) > 0, hits(low, L.CLOSURE) > 0
    return {
        "nonterminal": F.when(has(CLOSED), -5.0).otherwise(3.0),
        "meta": F.when(has(META), 2.0).otherwise(0.0),
        "hedging": (hits(low, L.HEDGES) - 2 * hits(low, L.APOLOGIES)).cast("double"),
        "affect": F.when(has(AFFECT), -3.0).otherwise(0.0),
        "variance": F.when(F.size(lengths) >= 2, F.least(population_deviation(lengths), F.lit(VARIANCE_CAP))).otherwise(0.0),
        "permission": F.when(hits(low, L.PERMISSIONS) > 0, 2.0).otherwise(0.0) + F.when(hits(low, L.LIFTS) > 0, 1.0).otherwise(0.0),
        "resistance": F.least(2.0 * hits(low, L.RESISTANCE), F.lit(RESISTANCE_CAP)),
        "liminal_meta": F.when(~has(META), 0.0).when(closing, -4.0).when(uncertain, 3.0).otherwise(0.0),
    }


def pair_weight(pair_count: Column) -> Column:
    return F.when(pair_count.isin(2, 3), 1.2).when(pair_count == 1, 0.8).when(pair_count >= 5, 0.4).otherwise(1.0)


def with_feels(chunks: DataFrame) -> DataFrame:
    """Add feels_score and feels_components (only parts that are not 0) to chunks with text, tags and pair_count."""
    seen = Searched("_has")
    parts = feels_parts(seen, F.col("tags"), F.col("_lengths"))
    chunks = chunks.withColumn("_low", F.lower("text")).withColumn("_has", seen.flags(F.col("_low")))
    return summed(chunks, parts).drop("_low", "_has")


def summed(chunks: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Add feels_score and feels_components to chunks with _low, by parts that refer to the column _lengths of sentences."""
    chunks = chunks.withColumn("_lengths", sentence_lengths(F.col("_low"))).withColumns({f"_{k}": v for k, v in parts.items()})
    total = sum((F.col(f"_{k}") for k in parts), F.lit(0.0))
    weight = pair_weight(F.col("pair_count"))
    named = {**{k: F.round(f"_{k}", 3) for k in parts}, "pair_weight": F.when(weight != 1.0, weight).otherwise(0.0)}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named.items()])
    return (
        chunks.withColumn("feels_score", F.round(total * weight, 3))
        .withColumn("feels_components", F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0)))
        .drop("_lengths", *[f"_{k}" for k in parts])
    )


def nearest_rank(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Value at index round((n - 1) * p), half to even, of each group in ascending order; exact, read off the counts of values."""
    p = min(1.0, max(0.0, p))
    rank = F.bround((F.col("_n") - 1) * p).cast("long") + 1
    counts = counted(df.select(*group, F.col(value).alias(name)), group, name)
    return counts.where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank)).select(*group, name)


def summary_by_size(scored: DataFrame, value: str = "feels_score", top: float = 0.3) -> DataFrame:
    """Count, least, largest, mean, median and top cutoff by pair_count, and over all (pair_count 0).

    Scores have three digits, so equal ones are counted first, with partial sums; all else is read off the counts.
    """
    counts = scored.where(F.col(value).isNotNull()).groupBy("pair_count", F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    sizes = F.array("pair_count", F.lit(0).cast(dict(scored.dtypes)["pair_count"]))
    both = counts.select(F.explode(sizes).alias("pair_count"), "_v", "_c").groupBy("pair_count", "_v").agg(F.sum("_c").alias("_c"))
    by_size = Window.partitionBy("pair_count")
    upto = F.sum("_c").over(by_size.orderBy("_v"))
    ranked = both.withColumn("_n", F.sum("_c").over(by_size)).withColumn("_upto", upto)
    place = F.bround((F.col("_n") - 1) * (1 - top)).cast("long") + 1
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    middle = (at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2
    return ranked.groupBy("pair_count").agg(
        F.sum("_c").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("largest"), F.round(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c"), 6).alias("mean"),
        F.round(middle, 6).alias("median"), at(place).alias("top_cutoff"), F.sum(F.when(F.col("_upto") >= place, F.col("_c"))).alias("top_count"),
    )
