"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


def latest_before(
    rows: DataFrame, facts: DataFrame, key: str, time: str, fact_time: str, columns: list[str], within: float | None = None, tie: str | None = None, segments: int | None = None
) -> DataFrame:
    """Add ``columns`` of the last of the ``facts`` with the row's key at or before its time; nulls if there is none.

    Of facts at one time the one with the largest ``tie`` counts; with ``within`` none that is so many seconds old or
    older. Both tables become one stream per key, ordered by time with facts first, and the last fact is carried on:
    one shuffle of both, in which a key with many rows is dealt out by time. Rows without a time get nulls, rows
    without a key those of facts without a key; every row stays once.
    """
    micros = F.unix_micros(fact_time)
    found = F.struct(micros.alias("_at"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    second = F.col(tie) if tie else F.lit(0)
    right = facts.where(F.col(fact_time).isNotNull()).select(F.col(key).alias("_k"), micros.alias("_t"), second.alias("_tie"), found.alias("_fact"))
    last = right.groupBy("_k", "_t").agg(F.max_by("_fact", F.struct(F.col("_tie").isNotNull(), "_tie")).alias("_fact")).withColumn("_side", F.lit(0))
    left = rows.select(F.col(key).alias("_k"), F.unix_micros(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    stream = last.unionByName(left, allowMissingColumns=True)
    carried = scan.last_before(scan.segmented(stream, "_k", ["_t", "_side"], segments), ["_k"], ["_t", "_side"], "_fact", "_seen").where("_side = 1")
    fresh = F.col("_t").isNotNull() if within is None else F.col("_t") - F.col("_seen._at") < int(within * 1_000_000)
    return carried.select("_row.*", *[F.when(fresh, F.col(f"_seen._v{i}")).alias(c) for i, c in enumerate(columns)])
