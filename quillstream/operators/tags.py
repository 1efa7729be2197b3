"""Tag lists as a tagger writes them: canonical names, priorities, filters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_regex, stripped

# Canonical tags by priority, and other names of theirs.
PRIORITY = [
    "resolution / closure", "question / hook", "affectively loaded / emotional", "meta-commentary", "mid-thought continuation",
    "topic transition", "refusal / constraint", "opening / orientation", "irrelevant filler",
]
ALIASES = {
    "opening": "opening / orientation", "orientation": "opening / orientation", "mid-thought": "mid-thought continuation",
    "midthought continuation": "mid-thought continuation", "refusal": "refusal / constraint", "constraint": "refusal / constraint",
    "meta": "meta-commentary", "meta commentary": "meta-commentary", "transition": "topic transition", "resolution": "resolution / closure",
    "closure": "resolution / closure", "question": "question / hook", "hook": "question / hook",
    "affectively loaded": "affectively loaded / emotional", "emotional": "affectively loaded / emotional",
    "irrelevant": "irrelevant filler", "filler": "irrelevant filler",
}


def parts(raw: Column) -> Column:
    """Comma- or line-separated parts of a tagger's answer, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(raw, "[,\n]"), stripped), lambda p: p != "")


def canonical(part: Column) -> Column:
    """The canonical tag that a part names, or null."""
    plain = F.regexp_replace(F.lower(part), python_regex(r"^[-*\s]+", ""), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(plain, python_regex(r"\s+", ""), F.lit(" ")), F.lit(r"^[ .;:]+|[ .;:]+$"), F.lit(""))
    names = {**{t: t for t in PRIORITY}, **ALIASES}
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*names.items())]), plain)


def known_tags(raw: Column) -> Column:
    """Canonical tags in order of appearance, each once."""
    return F.array_distinct(F.filter(F.transform(parts(raw), canonical), lambda t: t.isNotNull()))


def unknown_parts(raw: Column) -> Column:
    return F.filter(parts(raw), lambda p: canonical(p).isNull())


def primary_tags(tags: Column, limit: int = 2) -> Column:
    """The tags of highest priority."""
    places = F.array(*[F.lit(t) for t in PRIORITY])
    ordered = F.sort_array(F.transform(tags, lambda t: F.array_position(places, t)))
    return F.transform(F.slice(ordered, 1, limit), lambda i: F.element_at(places, i.cast("int")))


def scale(pair_count: Column) -> Column:
    return F.when(pair_count <= 1, "micro").when(pair_count <= 3, "meso").when(pair_count.isNotNull(), "macro")


def filtered_by_tags(df: DataFrame, tags: str, keep: list[str], drop: list[str]) -> DataFrame:
    """Rows without a tag of ``drop`` and with one of ``keep``."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    return df.where(~F.arrays_overlap(tags, array(drop)) & F.arrays_overlap(tags, array(keep)))


def tag_list(raw: str | None) -> list[str]:
    """Tags of a comma-separated option, trimmed, without empty ones."""
    return [t.strip() for t in (raw or "").split(",") if t.strip()]
