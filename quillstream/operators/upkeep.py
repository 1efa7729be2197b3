"""Upkeep of a growing memory: dated sections, due checks and their reasons, marks, proposals, context assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .relate import triggers

#: Days that stand for a step that was never applied.
NEVER = 999
# How a date is written in a section.
DATES = [r"\((\d{4}-\d{2}-\d{2})", r"Updated (\d{4}-\d{2}-\d{2})", r"\*\*New \((\d{4}-\d{2}-\d{2})\)"]
# Fields of an old state, and the fields they became.
RENAMED = {"last_consolidation": "last_proposal", "consolidation_count": "proposal_count"}
TIMES, COUNTS = ["last_scan", "last_proposal", "last_applied"], ["scan_count", "proposal_count", "applied_count"]
LISTS = ["history", "processed_note_hashes"]


def section(text: Column, title: str) -> Column:
    """What stands under ``## title`` up to the next such header or the end; null without the header."""
    found = F.regexp_extract(text, rf"(?s)## \Q{title}\E[ \t\f\r]*\n(?:\s*\n)?(.*?)(?=\n## |\z)", 1)
    return F.when(F.regexp_like(text, F.lit(rf"## \Q{title}\E\s*\n")), found)


def section_dates(text: Column, title: str) -> Column:
    """Dates in a section, in order; what is no date is left out, and a date that two patterns find counts twice."""
    inside = F.coalesce(section(text, title), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(inside, F.lit(p), F.lit(1)) for p in DATES])
    return F.sort_array(F.filter(F.transform(found, lambda d: F.try_to_date(d, "yyyy-MM-dd")), lambda d: d.isNotNull()))


def name_age(name: Column, on: Column) -> Column:
    """Days since the date a file name begins with; 0 where it begins with none."""
    return F.coalesce(F.datediff(on, F.try_to_date(F.substring(name, 1, 10), "yyyy-MM-dd")), F.lit(0))


def days_since(time: Column, on: Column) -> Column:
    """Whole days since a time; NEVER if there was none."""
    whole = F.floor((F.unix_micros(on) - F.unix_micros(time)) / (86_400 * 1_000_000)).cast("int")
    return F.coalesce(whole, F.lit(NEVER))


def due(facts: DataFrame, notes: int, tokens: int, days: int, age: int) -> DataFrame:
    """Add scan, scan_reasons, proposal and proposal_reasons to facts (new_notes, tokens, days, oldest)."""
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    c = F.col
    scans = {
        "notes": (c("new_notes") >= notes, text("new_notes: ", c("new_notes"), " unprocessed notes")),
        "size": (c("tokens") >= tokens, text("document_size: ~", c("tokens"), f" tokens (threshold: {tokens})")),
    }
    proposals = {
        "days": (c("days") >= days, F.when(c("days") >= NEVER, "days_since_applied: never applied").otherwise(text("days_since_applied: ", c("days"), " days"))),
        "age": (c("oldest") >= age, text("section_age: oldest entry is ", c("oldest"), " days old")),
    }
    scanned = triggers(facts, scans).withColumnsRenamed({"triggered": "scan", "reasons": "scan_reasons"})
    return triggers(scanned, proposals).withColumnsRenamed({"triggered": "proposal", "reasons": "proposal_reasons"})


def latest(files: DataFrame, group: list[str], time: str, name: str, k: int = 1) -> DataFrame:
    """The ``k`` files of each group with the latest time, of equal ones the first by name, with their place."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(time), name))
    return files.withColumn("place", place).where(F.col("place") <= k)


def gated(status: DataFrame, proposals: DataFrame, group: str, time: str, on: Column, rest: int = 3) -> DataFrame:
    """Add decision: skipped while the last proposal is under ``rest`` days old, else run or not due by ``proposal``."""
    last = proposals.groupBy(group).agg(F.max(time).alias("_last"))
    young = F.coalesce(days_since(F.col("_last"), on) < rest, F.lit(False))
    decision = F.when(young, "skipped").when(F.col("proposal"), "run").otherwise("not due")
    return status.join(last, group, "left").withColumn("decision", decision).drop("_last")


def marks(events: DataFrame, group: str, kind: str, time: str, trigger: str) -> DataFrame:
    """State of each group after its events scan, proposal and applied; applying counts as a scan too.

    Returns last and count of each kind, and the triggers of proposals and applications in order.
    """
    scan, proposal, applied = (F.col(kind) == k for k in ("scan", "proposal", "applied"))
    of = lambda is_it: [F.max(F.when(is_it, F.col(time))), F.count(F.when(is_it, 1))]
    history = F.sort_array(F.collect_list(F.when(proposal | applied, F.struct(F.col(time).alias("t"), F.concat_ws(":", kind, trigger).alias("e")))))
    found = [x.alias(n) for k, is_it in (("scan", scan | applied), ("proposal", proposal), ("applied", applied)) for x, n in zip(of(is_it), (f"last_{k}", f"{k}_count"), strict=True)]
    return events.groupBy(group).agg(*found, F.array_join(F.transform(history, lambda h: h["e"]), ",").alias("history"))


def migrated_state(json: Column) -> Column:
    """A state in today's fields: old names are read where the new ones are missing, the rest gets its default.

    Text that is not a JSON object counts as no state at all.
    """
    old = {new: name for name, new in RENAMED.items()}
    get = lambda name: F.get_json_object(json, f"$.{name}")
    value = lambda name: F.coalesce(get(name), get(old[name])) if name in old else get(name)
    times = [value(n).alias(n) for n in TIMES]
    counts = [F.coalesce(value(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in COUNTS]
    lists = [F.coalesce(F.json_array_length(get(n)), F.lit(0)).alias(n) for n in LISTS]
    return F.struct(*times, *counts, *lists)


def age_label(days: Column) -> Column:
    return F.when(days > 0, F.concat(F.lit("("), days.cast("string"), F.lit(" days old)"))).otherwise("(today)")


def shortened(text: Column, most: int = 500) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[... truncated ...]"))).otherwise(text)


def assembled(document: Column, notes: Column, archived: Column) -> Column:
    """Sections of a context, parted by rules: the document (if any), the notes and, if any, what was archived."""
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body))
    listed = F.coalesce(F.nullif(notes, F.lit("")), F.lit("(No notes found)"))
    return F.concat_ws("\n\n---\n\n", part("Current document", document), part("Recent notes", listed), part("Recently archived (for reference)", archived))


def note_line() -> Column:
    """A line of a note (path, date, lines, first_line) for a scan; its first line is cut at 80."""
    return F.concat(F.lit("- **"), "path", F.lit("** ("), F.coalesce("date", F.lit("unknown")), F.lit(", "), F.col("lines").cast("string"), F.lit(" lines)\n  First line: "), F.substring("first_line", 1, 80), F.lit("..."))


def note_lines(notes: DataFrame, group: str, order: str) -> DataFrame:
    """One text a group: a line each note."""
    lines = notes.select(group, F.struct(F.col(order).alias("k"), note_line().alias("v")).alias("_n")).groupBy(group).agg(F.sort_array(F.collect_list("_n")).alias("_n"))
    return lines.select(group, F.array_join(F.transform("_n", lambda n: n["v"]), "\n").alias("notes"))


def digests(pieces: DataFrame, group: str, order: list[str], text: str, between: str) -> DataFrame:
    """(group, digest, chars): MD5 and length of each group's texts (null ones left out) put together in order.

    ``between`` names what stands before a text, unless it is the first of its group. Rows stream through sorted
    tasks, so no group's text is held; as a hash is taken in order, a group is hashed in one task.
    """
    kinds = f"`{group}` {dict(pieces.dtypes)[group]}, digest string, chars long"
    schema = to_arrow_schema(_parse_datatype_string(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, md5, chars = False, None, None, 0
        shut = lambda: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((last, md5.hexdigest(), chars), schema, strict=True)], schema=schema)
        for batch in batches:
            for key, body, rule in zip(*[batch.column(c).to_pylist() for c in (group, text, between)], strict=True):
                fresh = not begun or key != last
                if fresh:
                    if begun:
                        yield shut()
                    begun, last, md5, chars = True, key, hashlib.md5(), 0
                piece = body if fresh else rule + body
                md5.update(piece.encode())
                chars += len(piece)
        if begun:
            yield shut()

    lean = pieces.where(F.col(text).isNotNull()).select(*dict.fromkeys([group, *order, text, between]))
    return lean.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInArrow(run, kinds)


def proposal_text(title: str, reviewed: Column, tokens: Column, sections: dict[str, Column]) -> Column:
    """Text of a proposal: what was reviewed, then each section's items, or that nothing was flagged."""
    blocks = [F.concat(F.lit(f"## {name}\n\n"), F.coalesce(F.nullif(F.array_join(items, "\n\n"), F.lit("")), F.lit("(Nothing flagged)"))) for name, items in sections.items()]
    head = F.concat(F.lit(f"# {title}\n\nNotes reviewed: "), reviewed.cast("string"), F.lit("\nTotal context tokens (estimated): "), tokens.cast("string"))
    return F.concat_ws("\n\n---\n\n", head, *blocks)
