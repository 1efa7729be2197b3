"""Pairs of chunk records: reading blocks, key forms, filters, counts, selection, skips of work already done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines, stripped
from .sampling import draw
from .tags import primary_tags, scale

# Header names that open a block of a speaker.
SPEAKERS = {"Human": "Human", "W": "Human", "Assistant": "Assistant", "C": "Assistant"}
HEADER = r"^===\s*(.+?)\s*===$"


def role_blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block, role, text) of the blocks under ``=== NAME ===`` lines of a known speaker.

    Any other header closes the block before it, and what follows is dropped; so are empty lines at a block's end and
    blocks without lines. Lines end as in Python.
    """
    lines = texts.select(key, F.posexplode(split_lines(F.col(text))).alias("_i", "_line"))
    name = F.nullif(F.regexp_extract("_line", HEADER, 1), F.lit(""))
    named = lines.withColumn("_name", name).withColumn("block", F.count("_name").over(Window.partitionBy(key).orderBy("_i")))
    body = F.sort_array(F.collect_list(F.when(F.col("_name").isNull(), F.struct("_i", "_line"))))
    blocks = named.where("block > 0").groupBy(key, "block").agg(F.max("_name").alias("_name"), body.alias("_body"))
    role = F.lit(None).cast("string")
    for header, speaker in SPEAKERS.items():
        role = F.when(F.col("_name") == header, speaker).otherwise(role)
    joined = F.regexp_replace(F.array_join(F.transform("_body", lambda x: x["_line"]), "\n"), r"\n+\z", "")
    found = blocks.select(key, F.col("block").cast("int").alias("block"), role.alias("role"), joined.alias("text"))
    return found.where("role IS NOT NULL AND text <> ''")


def standard_pairs(pairs: Column) -> Column:
    """Pairs with the keys voice_a and voice_b, or human and assistant, under the first names; others are dropped."""
    both = lambda p, a, b: F.when(p[a].isNotNull() & p[b].isNotNull(), F.struct(p[a].alias("voice_a"), p[b].alias("voice_b")))
    named = F.transform(pairs, lambda p: F.coalesce(both(p, "voice_a", "voice_b"), both(p, "human", "assistant")))
    return F.filter(named, lambda p: p.isNotNull())


def full_pairs(pairs: Column, least: int = 0) -> Column:
    """Pairs of which neither voice is blank or shorter than ``least`` characters without its blank ends."""
    enough = lambda v: F.char_length(stripped(v)) >= max(1, least)
    return F.filter(pairs, lambda p: enough(p["voice_a"]) & enough(p["voice_b"]))


def recounted(records: DataFrame) -> DataFrame:
    """Records that still have pairs; a pair_count that no longer holds is kept as pair_count_original."""
    n = F.size("pairs")
    changed = F.col("pair_count").isNotNull() & (F.col("pair_count") != n)
    original = F.when(changed, F.col("pair_count"))
    return records.where(n > 0).withColumn("pair_count_original", original).withColumn("pair_count", F.when(F.col("pair_count").isNotNull(), n))


def selected_pairs(pairs: Column, most: int, how: Column, key: list[str], seed: int) -> Column:
    """The first, last or, by a draw from the key, any ``most`` pairs in a row; all if there are no more."""
    spare = F.size(pairs) - most
    start = F.when(how == "last", spare).when(how == "random", F.pmod(draw(key, seed), spare + 1)).otherwise(0)
    return F.when(spare <= 0, pairs).otherwise(F.slice(pairs, start.cast("int") + 1, F.lit(most)))


def long_enough(text: Column, least: int = 40) -> Column:
    return F.char_length(text) >= least


def score_once(existing: Column, computed: Column, force: bool = False) -> Column:
    """The score there is, else (or with ``force``) the computed one, rounded to 3."""
    return F.round(computed, 3) if force else F.coalesce(existing, F.round(computed, 3))


def tag_once(records: DataFrame) -> DataFrame:
    """Add skipped; records with tags get what they lack of tags_primary and scale, others wait for the tagger."""
    tagged = F.coalesce(F.size("tags") > 0, F.lit(False))
    back = lambda name, value: F.when(tagged, F.coalesce(name, value)).otherwise(F.col(name)).alias(name)
    rest = [c for c in records.columns if c not in ("tags_primary", "scale")]
    return records.select(*rest, back("tags_primary", primary_tags(F.col("tags"))), back("scale", scale(F.col("pair_count"))), tagged.alias("skipped"))


def bookkeeping(records: DataFrame, group: list[str], skipped: str, error: str) -> DataFrame:
    """What a tagger's run did, by group: records seen, skipped, done and failed."""
    failed = F.col(error).isNotNull()
    return records.groupBy(*group).agg(
        F.count("*").alias("seen"), F.count(F.when(F.col(skipped), 1)).alias("skipped"), F.count(F.when(~F.col(skipped) & ~failed, 1)).alias("done"), F.count(F.when(~F.col(skipped) & failed, 1)).alias("failed"),
    )


def candidates(records: DataFrame, least: float, scales: list[str]) -> DataFrame:
    """Records with a feels score (missing: 0) of at least ``least`` and, if any are named, one of the scales."""
    enough = records.where(F.coalesce("feels_score", F.lit(0.0)) >= least)
    return enough.where(F.lower(F.coalesce("scale", F.lit(""))).isin([s.strip().lower() for s in scales])) if scales else enough


def first_records(records: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` records: a report, or a bounded batch for a tagger."""
    return records.orderBy(*order).limit(most)


def parsed_overlaps(sizes: str, overlaps: str) -> dict[int, int]:
    """Overlap by window size from ``1,2,5`` and ``2:1,5:2``; raises ValueError where an entry is malformed."""
    wanted = [int(s) for s in sizes.split(",") if s.strip()]
    if not wanted or min(wanted) <= 0:
        raise ValueError(f"window sizes must be positive: {sizes!r}")
    given = {}
    for entry in filter(None, (e.strip() for e in overlaps.split(","))):
        size, colon, overlap = entry.partition(":")
        if not colon:
            raise ValueError(f"not size:overlap: {entry!r}")
        given[int(size)] = int(overlap)
    found = {size: given.get(size, 0) for size in wanted}
    for size, overlap in found.items():
        if not 0 <= overlap < size:
            raise ValueError(f"the overlap of size {size} must be from 0 to {size - 1}, not {overlap}")
    return found
