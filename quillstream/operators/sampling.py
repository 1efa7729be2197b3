"""Weights by relevance, recency and past use; pools, softmax and seeded sampling."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ranked

DECAY = 0.85


def salience_boost(salience: Column, factor: float = 0.03, cap: float = 1.3) -> Column:
    return F.lit(1.0) if factor <= 0 else F.least(1 + F.coalesce(salience, F.lit(0.0)) * factor, F.lit(cap))


def recency(date: Column, on: Column, halflife: float = 14.0) -> Column:
    """Power-law weight of a date seen from a day: 1 today (or in future, or without a date), 1/2 after the half-life."""
    if halflife <= 0:
        return F.lit(1.0)
    days = F.greatest(F.datediff(on, date), F.lit(0))
    return F.coalesce(F.pow(1.0 + days, F.lit(-log(2) / log(1 + halflife))), F.lit(1.0))


def with_effective_score(df: DataFrame, state: DataFrame, key: str, on: Column, halflife: float = 14.0) -> DataFrame:
    """Add decay (joined by key, 1 if unknown), recency, boost and effective = feels_score times all three."""
    joined = df.join(state.select(key, F.col("weight").alias("_weight")), key, "left")
    return (
        joined.withColumn("decay", F.coalesce("_weight", F.lit(1.0)))
        .withColumn("recency", recency(F.col("source_date"), on, halflife))
        .withColumn("boost", salience_boost(F.col("salience")))
        .withColumn("effective", F.col("feels_score") * F.col("decay") * F.col("recency") * F.col("boost"))
        .drop("_weight")
    )


def top_share(df: DataFrame, group: str, score: str, tie: list[str], share: float, bottom: bool = False) -> DataFrame:
    """The best (or worst) max(1, floor(n * share)) rows of every group, with their rank."""
    ties = [-F.col(t) if bottom else F.col(t) for t in tie]
    wanted = lambda rank, n: rank <= F.greatest(F.lit(1), F.floor(n * share))
    return ranked(df, [group], F.col(score) if bottom else -F.col(score), ties, wanted).drop("_n")


def with_softmax(df: DataFrame, group: str, score: str, temperature: float) -> DataFrame:
    """Add probability: softmax of the score within each group, uniform if it sums to 0.

    The groups' largest scores and sums are aggregates with partial results, joined back.
    """
    named = F.col(group).alias("_g")
    tops = df.groupBy(named).agg(F.max(score).alias("_m"), F.count("*").alias("_n"))
    scaled = df.join(tops, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_e", F.exp((F.col(score) - F.col("_m")) / max(temperature, 0.001)))
    sums = scaled.groupBy(F.col(group).alias("_h")).agg(F.sum("_e").alias("_s"))
    joined = scaled.join(sums, F.col(group).eqNullSafe(F.col("_h")))
    return joined.withColumn("probability", F.when(F.col("_s") > 0, F.col("_e") / F.col("_s")).otherwise(1.0 / F.col("_n"))).drop("_g", "_h", "_m", "_n", "_e", "_s")


def draw(key: list[str], seed: int) -> Column:
    """A whole number under 2^48 drawn by an MD5 hash of the key; equal for equal seeds, whatever the partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(key: list[str], seed: int) -> Column:
    """A number in (0, 1) drawn by ``draw``."""
    return (draw(key, seed) + 0.5) / float(1 << 48)


def weighted_sample(df: DataFrame, weight: str, key: list[str], k: int, seed: int) -> DataFrame:
    """``k`` rows without replacement, with chances as by successive weighted draws: the least -ln(u) / weight."""
    drawn = df.where(F.col(weight) > 0).withColumn("_key", -F.ln(uniform(key, seed)) / F.col(weight))
    return drawn.orderBy("_key", *key).limit(k).drop("_key")


def uniform_sample(df: DataFrame, key: list[str], k: int, seed: int) -> DataFrame:
    return df.orderBy(uniform(key, seed), *key).limit(k)


def draw_with_replacement(df: DataFrame, probability: str, order: list[str], k: int, seed: int) -> DataFrame:
    """``k`` draws, each by the given chances: (draw, order columns), the least -ln(u) / probability of all rows.

    Draws are independent races, so partial minima meet in one row a draw; nothing is sorted or numbered.
    """
    key = F.struct(*order)
    races = [F.min_by(key, F.struct(-F.ln(uniform(order, seed * 1000 + i)) / F.col(probability), key)).alias(f"_{i}") for i in range(k)]
    won = df.where(F.col(probability) > 0).agg(*races)
    return won.select(F.posexplode(F.array(*[f"_{i}" for i in range(k)])).alias("draw", "_w")).where("_w IS NOT NULL").select("draw", "_w.*")


def decayed_weights(chosen: DataFrame, key: str) -> DataFrame:
    """Weight of every key after its selections: 0.85 for each."""
    return chosen.groupBy(key).agg(F.pow(F.lit(DECAY), F.count("*")).alias("weight"))
