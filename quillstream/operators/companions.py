"""Companions of a run: availability and health, intrusions, notes carried over, dialogs, inbox texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import draw, uniform

# Failures in a row from which calls stop, and for how many pulses (doubling up to a most).
FAILURES, COOLDOWN, MOST_COOLDOWN = 2, 3, 48
INTRUSION, CYCLE, MOST_TURNS = 0.12, 6, 6
#: A carried note under this length, or with this text, says nothing.
LEAST_NOTE, NO_NOTE = 100, "No carry note yet"
ACTIVE = ["fresh", "considering"]


def cooldown(failures: Column) -> Column:
    """Pulses to wait after so many failures in a row."""
    return F.when(failures < FAILURES, 0).otherwise(F.least(F.lit(MOST_COOLDOWN), COOLDOWN * F.pow(F.lit(2), F.least(F.lit(10), failures - FAILURES))).cast("int"))


def availability(pulses: DataFrame, stream: str, order: str, failed: str) -> DataFrame:
    """Add pulse (from 1), failures (in a row before it) and available: few failures, or the cooldown has passed.

    ``failed`` is whether the pulse's call failed; null: there was no call, which changes nothing.
    """
    w = Window.partitionBy(stream).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = pulses.withColumn("pulse", F.row_number().over(w))
    fails = placed.withColumn("_fails", F.count(F.when(F.col(failed), 1)).over(past)).withColumn("_last", F.max(F.when(F.col(failed), F.col("pulse"))).over(past))
    cleared = F.coalesce(F.max(F.when(~F.col(failed), F.col("_fails"))).over(past), F.lit(0))
    counted = fails.withColumn("failures", (F.col("_fails") - cleared).cast("int"))
    open_again = F.col("pulse") - F.col("_last") >= cooldown(F.col("failures"))
    return counted.withColumn("available", (F.col("failures") < FAILURES) | open_again).drop("_fails", "_last")


def health(pulses: DataFrame, stream: str, order: str, failed: str, time: str) -> DataFrame:
    """Per stream after its last pulse: failures in a row, available at the next one, cooldown (0 if available), and the
    times of the last failure and success."""
    w = Window.partitionBy(stream).orderBy(order)
    numbered = pulses.withColumn("_n", F.row_number().over(w))
    grouped = numbered.groupBy(stream).agg(
        F.max("_n").alias("_n"), F.max(F.when(F.col(failed), F.col("_n"))).alias("_bad"), F.max(F.when(~F.col(failed), F.col("_n"))).alias("_good"),
        F.max(F.when(F.col(failed), F.col(time))).alias("last_failure"), F.max(F.when(~F.col(failed), F.col(time))).alias("last_success"),
    )
    since = numbered.join(grouped.select(stream, "_good"), stream).where(F.col(failed) & (F.col("_n") > F.coalesce("_good", F.lit(0))))
    row = since.groupBy(stream).agg(F.count("*").cast("int").alias("_f"))
    found = grouped.join(row, stream, "left").withColumn("failures", F.coalesce("_f", F.lit(0)))
    ready = (F.col("failures") < FAILURES) | (F.col("_n") + 1 - F.col("_bad") >= cooldown(F.col("failures")))
    return found.withColumn("available", ready).select(stream, "failures", "available", F.when(~F.col("available"), cooldown(F.col("failures"))).otherwise(0).alias("cooldown"), "last_failure", "last_success")


def cycle_status(placed: DataFrame, stream: str, order: str, allowed: str = "allowed") -> DataFrame:
    """Add invocation_available (nothing was invoked in the cycle so far) and until_reset to pulses with ``position``."""
    w = Window.partitionBy(stream).orderBy(order)
    starts = placed.withColumn("_cycle", F.sum((F.col("position") == 1).cast("int")).over(w))
    used = F.max(F.col(allowed).cast("int")).over(Window.partitionBy(stream, "_cycle").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return starts.withColumn("invocation_available", F.coalesce(used, F.lit(0)) == 0).withColumn("until_reset", CYCLE - F.col("position") + 1).drop("_cycle")


def intrusions(pulses: DataFrame, key: list[str], available: str, seed: int, chance: float = INTRUSION) -> DataFrame:
    """Add companion: with a chance, one of those available (an array of names), by draws from the key; else null."""
    names = F.col(available)
    chosen = F.element_at(names, (F.pmod(draw(key, seed + 1), F.greatest(F.size(names), F.lit(1))) + 1).cast("int"))
    return pulses.withColumn("companion", F.when((uniform(key, seed) < chance) & (F.size(names) > 0), chosen))


def carried(note: Column) -> Column:
    """A note carried over, trimmed; null where it is the placeholder or too short to say anything."""
    plain = F.regexp_replace(note, r"(?U)^\s+|\s+\z", "")
    return F.when(~F.contains(plain, F.lit(NO_NOTE)) & (F.char_length(plain) >= LEAST_NOTE), plain)


def dialog_text(companion: Column, intrusion: Column, started: Column, dialog: Column, own: str) -> Column:
    """Markdown of a dialog: who, how, when, then up to MOST_TURNS turns; ``own`` is the side that is named as it is."""
    turns = F.slice(dialog, 1, MOST_TURNS)
    who = lambda s: F.when(s == own, F.lit(f"**{own.capitalize()}:**")).otherwise(F.concat(F.lit("**"), F.upper(s), F.lit(":**")))
    body = F.transform(turns, lambda t: F.concat(F.lit("\n"), who(t["speaker"]), F.lit("\n"), t["content"], F.lit("\n")))
    mode = F.when(intrusion, "intruded").otherwise("invoked")
    head = [F.concat(F.lit("\n### Companion dialog: "), companion, F.lit(" ("), mode, F.lit(")\n")), F.concat(F.lit("*"), started, F.lit(" - "), F.size(turns).cast("string"), F.lit(" turns*\n"))]
    return F.array_join(F.concat(F.array(*head), body), "\n")


def quick_summary(logs: DataFrame, run: str, companion: str, pulses: Column) -> DataFrame:
    """One line a run: pulses, dialogs and the companions in them."""
    found = logs.groupBy(run).agg(F.sort_array(F.collect_set(companion)).alias("_names"), F.count(companion).alias("_n"), F.max(pulses).alias("_p"))
    names = F.when(F.size("_names") > 0, F.array_join("_names", ", ")).otherwise("none")
    return found.select(run, F.concat(F.col("_p").cast("string"), F.lit(" pulses, "), F.col("_n").cast("string"), F.lit(" companion dialogs ("), names, F.lit(")")).alias("summary"))


def active_since(pulses: DataFrame, logs: DataFrame, key: str, start: str, time: str) -> DataFrame:
    """Pulses with a log of their key at or after their start: only each key's last log decides."""
    last = logs.groupBy(key).agg(F.max(time).alias("_last"))
    return pulses.join(last, key).where(F.col("_last") >= F.col(start)).drop("_last")


def inbox_section(items: DataFrame, group: str) -> DataFrame:
    """One text a group with its active items and their state; groups without any are left out."""
    line = F.concat(F.lit("- `"), "filename", F.lit("` "), F.when(F.col("status") == "fresh", "(new)").otherwise("(considering)"))
    active = items.where(F.col("status").isin(ACTIVE)).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("filename", line.alias("line")))).alias("_l"))
    return active.select(group, F.concat(F.lit("**Drops:**\nItems waiting:\n\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("section"))


def without_tool_markers(text: Column) -> Column:
    """Tool markers as quoted lines, and no more than one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(text, r"\[Tool: ([^\]]+)\]", "\n> *Using: $1*\n"), r"\n{3,}", "\n\n")


def vocabulary(text: Column, first: str, second: str, most: int = 2000) -> Column:
    """The part between two headers, cut at ``most`` characters; without the first header the start of the text."""
    cut = lambda t: F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("\n\n[...truncated for length]"))).otherwise(t)
    start = F.locate(first, text)
    rest = F.substr(text, start, F.lit(1 << 30))
    end = F.locate(second, rest)
    part = F.when(end > 0, F.substr(rest, F.lit(1), end - 1)).otherwise(F.substring(rest, 1, most))
    return F.when(start > 0, cut(F.regexp_replace(part, r"(?U)^\s+|\s+\z", ""))).otherwise(cut(text))


def session_id(time: Column) -> Column:
    """Time of the start and eight hex digits of its SHA-256, such as 2024-05-01_123000_0a1b2c3d."""
    return F.concat(F.date_format(time, "yyyy-MM-dd_HHmmss"), F.lit("_"), F.substring(F.sha2(F.unix_micros(time).cast("string"), 256), 1, 8))
