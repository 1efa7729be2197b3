"""Feels score and salience of windows of pairs, from what each pair has.

A pair lies in several windows of each size. Its text is lowered and searched once, and a window has what one of its
pairs has; only patterns that may reach from one line into the next are searched in the text of a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Searched, guarded, needed_literals, python_regex, within_lines
from . import chunking, feels, saliency


def with_both_scores(pairs: DataFrame, overlaps: dict[int, int], families: list[tuple[str, float, list[str]]], dressed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The windows with feels_score, feels_components, h_<family> and salience; ``dressed`` adds their tags, and what else is wanted.

    The scores are those of ``feels.with_feels`` and ``saliency.with_salience`` over the text of a window.
    """
    seen, low = Searched("_has"), F.col("_low")
    parts = feels.feels_parts(seen, F.col("tags"), F.col("_lengths"))

    def found(p: str) -> Column:
        where = low if any("\n" in x for x in needed_literals(p)) else seen
        return guarded(where, p, F.regexp_like(low, python_regex(p)).cast("int"))

    each = {p: found(p) for _, _, patterns in families for p in patterns}
    local = [p for p in each if within_lines(p)]
    searched = pairs.select("conv_id", "pair", F.lower(chunking.voices(F.struct("voice_a", "voice_b"))).alias("_low"))
    searched = searched.withColumn("_has", seen.flags(low)).withColumn("_hit", F.array(*[each[p] == 1 for p in local]).cast("array<boolean>"))

    def either(flags: str, count: int) -> Column:
        """For each flag whether a pair has it; a pair without a text has none."""
        of = lambda i: F.exists("pairs", lambda p: F.coalesce(F.get(p[flags], i), F.lit(False)))
        return F.transform(F.array(*[F.lit(i) for i in range(count)]).cast("array<int>"), of)

    windows = chunking.windows(searched, ["_low", "_has", "_hit"], overlaps)
    texts = chunking.joined(F.transform("pairs", lambda p: p["_low"]))
    windows = windows.withColumns({"_low": texts, "_has": either("_has", len(seen.places)), "_hit": either("_hit", len(local))})
    hit = {p: F.get(F.col("_hit"), F.lit(i)).cast("int") for i, p in enumerate(local)}
    return saliency.summed(feels.summed(dressed(windows), parts), families, each | hit).drop("pairs", "_low", "_has", "_hit")
