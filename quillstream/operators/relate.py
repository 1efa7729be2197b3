"""Relational steps between logs and notes: interval match, anti joins, full outer sync, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def interval_match(logs: DataFrame, sessions: DataFrame, keys: list[str], log: str, session: str, log_time: str, session_time: str, seconds: int) -> DataFrame:
    """Each log with the first session (by ``session``) whose time is under ``seconds`` away; inner.

    Both sides meet in time buckets of that width, sessions in three neighbouring ones, so it is an equi join;
    keys narrow it further.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    left = logs.withColumn("_b", bucket(log_time))
    right = sessions.select(*keys, session, session_time, F.explode(F.array(*[bucket(session_time) + d for d in (-1, 0, 1)])).alias("_b"))
    near = left.join(right, [*keys, "_b"]).where(F.abs(F.unix_micros(log_time) - F.unix_micros(session_time)) < seconds * 1_000_000)
    return near.groupBy(*keys, log).agg(F.min(session).alias(session))


def unmatched(logs: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return logs.join(matched, key, "left_anti")


def unreferenced(notes: DataFrame, document: DataFrame, path: str = "path", date: str = "date") -> DataFrame:
    """Notes that a document names neither by file, by stem nor by date; the document's rows have ``text``, all of which count."""
    stem = F.regexp_replace(F.col(path), r"\.md$", "")
    named = F.contains(F.lower("_text"), F.lower(stem)) | F.contains(F.lower("_text"), F.lower(path)) | F.coalesce(F.contains("_text", date), F.lit(False))
    return notes.join(document.select(F.col("text").alias("_text")), named, "left_anti")


def new_rows(rows: DataFrame, seen: DataFrame, digest: str) -> DataFrame:
    """Rows whose digest was not processed before."""
    return rows.join(seen, digest, "left_anti")


def sync(listing: DataFrame, state: DataFrame, key: str, now: Column) -> DataFrame:
    """State after a look at the listing: new items are fresh, known ones are seen now, missing ones go."""
    here = listing.select(key, F.lit(True).alias("_here"))
    both = here.join(state, key, "full_outer").where("_here")
    return both.select(key, F.coalesce("status", F.lit("fresh")).alias("status"), F.coalesce("discovered", now).alias("discovered"), now.alias("last_seen"))


def packed(items: DataFrame, group: str, order: list[Column], tokens: str, limit: int, reserve: int = 1000, segments: int | None = None) -> DataFrame:
    """The items of each group, in order, up to the first that would pass the limit less a reserve."""
    rows = scan.segmented(items, group, order, segments)
    upto = scan.running_sums(rows, [group], order, {"used": F.col(tokens)})
    return upto.where(F.col("used") < limit - reserve).drop(scan.SEGMENT)


def triggers(facts: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add triggered and reasons: the texts of the rules (condition, reason) that hold."""
    reasons = F.filter(F.array(*[F.when(c, text) for c, text in rules.values()]), lambda r: r.isNotNull())
    return facts.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("triggered", F.size(reasons) > 0)


def dispatched(events: DataFrame, subsystems: DataFrame, event: str) -> DataFrame:
    """Events with every subsystem that lists them, with its place by priority (50 if not set, then by name)."""
    listed = subsystems.select("subsystem", F.coalesce("priority", F.lit(50)).alias("priority"), F.explode("triggers").alias(event))
    places = listed.withColumn("place", F.row_number().over(Window.partitionBy(event).orderBy("priority", "subsystem")))
    return events.join(places, event)
