"""Conversation turns to pairs of turns to overlapping windows of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import python_regex, stripped

#: Window sizes and the pairs that neighbouring windows of a size share.
OVERLAPS = {1: 0, 2: 1, 3: 1, 5: 2}


def speaker_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with roles Human and Assistant; other roles are dropped."""
    role = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "Assistant")
    return conversations.select("conv_id", "turn", role.alias("role"), "text").where("role IS NOT NULL")


def coalesced_turns(turns: DataFrame) -> DataFrame:
    """Merge runs of turns of one role; a turn equal to the text merged so far adds nothing.

    Everything is partitioned by conversation once: runs are numbered by a running sum over role changes.
    """
    by_conversation = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.coalesce((F.lag("role").over(by_conversation) != F.col("role")).cast("int"), F.lit(1))
    runs = turns.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(by_conversation))
    grouped = runs.groupBy("conv_id", "run").agg(
        F.first("role").alias("role"), F.min("turn").alias("turn"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t")
    )
    texts = F.transform("_t", lambda x: stripped(x["text"]))
    join = lambda a, b: F.when(a == b, a).when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))
    return grouped.select("conv_id", "run", "turn", "role", F.aggregate(texts, F.lit(""), join).alias("text"))


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pair, voice_a, voice_b) for every Human run that an Assistant run follows; pair counts from 0."""
    by_conversation = Window.partitionBy("conv_id").orderBy("run")
    ahead = turns.withColumn("_role", F.lead("role").over(by_conversation)).withColumn("voice_b", F.lead("text").over(by_conversation))
    pairs = ahead.where((F.col("role") == "Human") & (F.col("_role") == "Assistant"))
    return pairs.select("conv_id", (F.row_number().over(by_conversation) - 1).alias("pair"), F.col("text").alias("voice_a"), "voice_b")


def voices(pair: Column) -> Column:
    return F.concat(F.lit("=== Voice A ===\n"), pair["voice_a"], F.lit("\n\n=== Voice B ===\n"), pair["voice_b"])


def joined(texts: Column) -> Column:
    return F.array_join(texts, "\n\n")


def pair_text(pairs: Column) -> Column:
    return joined(F.transform(pairs, voices))


def chunk_windows(pairs: DataFrame, overlaps: dict[int, int] | None = None) -> DataFrame:
    """(conv_id, pair_count, chunk_index, pairs, text): windows of each size, at a stride of size minus overlap."""
    return windows(pairs, ["voice_a", "voice_b"], overlaps).withColumn("text", pair_text(F.col("pairs")))


def windows(pairs: DataFrame, columns: list[str], overlaps: dict[int, int] | None = None) -> DataFrame:
    """(conv_id, pair_count, chunk_index, pairs): the windows, with some columns of each pair."""
    overlaps = OVERLAPS if overlaps is None else overlaps
    whole = pairs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pair", *columns))).alias("_pairs"))
    sizes = F.array(*[F.struct(F.lit(k).alias("size"), F.lit(max(1, k - o)).alias("stride")) for k, o in overlaps.items()])
    sized = whole.select("conv_id", "_pairs", F.explode(sizes).alias("w")).where(F.size("_pairs") >= F.col("w.size"))
    starts = F.sequence(F.lit(0), F.size("_pairs") - F.col("w.size"), F.col("w.stride"))
    placed = sized.select("conv_id", "_pairs", "w", F.posexplode(starts).alias("chunk_index", "start"))
    return placed.select("conv_id", F.col("w.size").alias("pair_count"), "chunk_index", F.slice("_pairs", F.col("start") + 1, F.col("w.size")).alias("pairs"))


def without_thinking(text: Column) -> Column:
    """Drop lines of <thinking> blocks: an opening line goes, and all up to the closing line unless it closes itself."""
    fold = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside")),
        lambda s, line: F.when(
            s["inside"], F.struct(s["kept"].alias("kept"), (~F.contains(line, F.lit("</thinking>"))).alias("inside"))
        )
        .when(F.contains(line, F.lit("<thinking>")), F.struct(s["kept"].alias("kept"), (~F.contains(line, F.lit("</thinking>"))).alias("inside")))
        .when(F.contains(line, F.lit("</thinking>")), F.struct(s["kept"].alias("kept"), F.lit(False).alias("inside")))
        .otherwise(F.struct(F.concat(s["kept"], F.array(line)).alias("kept"), F.lit(False).alias("inside"))),
    )
    return F.array_join(fold["kept"], "\n")


def cleaned(text: Column) -> Column:
    """Without thinking blocks, attachment lines, trailing blanks, blank ends and more than two blank lines in a row."""
    lines = F.split(without_thinking(text), "\n")
    kept = F.filter(lines, lambda x: ~F.ltrim(x).startswith("[attachment:"))
    joined = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, python_regex(r"\s+\z", ""), F.lit(""))), "\n")
    return F.regexp_replace(F.regexp_replace(joined, F.lit(r"^\n+|\n+\z"), F.lit("")), F.lit(r"\n{4,}"), F.lit("\n\n\n"))


def masked_names(text: Column) -> Column:
    """Replace capitalised words by [x], but not in header lines."""
    line = lambda x: F.when(x.startswith("==="), x).otherwise(F.regexp_replace(x, python_regex(r"\b[A-Z][a-z]+\b", ""), F.lit("[x]")))
    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def clipped(text: Column, n: int) -> Column:
    """The first ``n`` sentences."""
    return F.array_join(F.slice(F.split(stripped(text), r"(?<=[.!?])\s+"), 1, n), " ")


def labels(text: Column) -> Column:
    """The first two ``=== x ===`` headers."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^===\s*(.+?)\s*===$"), F.lit(1)), 1, 2)
