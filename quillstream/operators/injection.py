"""Texts that tell a run about itself: prediction errors, feelings, drives, memory pointers, extracted sections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import affordances

DEVIATION = 1.5
# What a drive is called in a text, and from which level it is told.
DRIVES = {
    "building": ("Need to build, fix, or extend infrastructure", 0.6), "publishing": ("Drive to produce artifacts for external sharing", 0.5),
    "experimenting": ("Curiosity channeled toward structured investigation", 0.55),
}
STRONG = 0.8
# Distortions to check, and the lenses of each feeling.
DISTORTIONS = {
    "catastrophizing": "Assuming worst-case outcomes ('this will never work')",
    "all_or_nothing": "Binary thinking with no middle ground ('either perfect or failure')",
    "overgeneralizing": "Extending one instance to all cases ('this always happens')",
}
LENSES = {
    "frustrated": ["cbt", "rt"], "anxious": ["cbt", "pct"], "bored": ["rt", "pct"], "depleted": ["pct", "rt"], "engaged_critical": ["pct", "cbt"],
    "curious": ["pct"], "alert": ["pct"], "excited": ["pct"], "delighted": ["pct"], "content": [], "peaceful": [], "neutral": [],
}
# Openings of the parts of a prompt that change from pulse to pulse; the last in any case of letters.
SECTIONS = {
    "texture": "Stylistic residue.*?:", "signals": "Interoceptive signal.*?", "errors": "Prediction error.*?", "feeling": "Feeling state:.*?",
    "upkeep": "(?i:consolidation|Pending Consolidation).*?",
}


def any_deviation(scores: list[Column], limit: float = DEVIATION) -> Column:
    """Whether any score that is known is further than the limit from 0."""
    return reduce(or_, [F.coalesce(F.abs(z) > limit, F.lit(False)) for z in scores])


def prediction_error(predicted: Column, observed: Column, signals: dict[str, tuple[Column, Column]]) -> Column:
    """Text of signals (value, score) after a prediction; null where the type was right and nothing deviates."""
    notable = any_deviation([z for _, z in signals.values()])
    header = F.when(predicted == observed, F.concat(F.lit("Interoceptive signal ("), observed, F.lit(" context, confirmed):"))).otherwise(
        F.concat(F.lit("Interoceptive signal (predicted: "), predicted, F.lit(", observed: "), observed, F.lit("):"))
    )

    def line(name: str, value: Column, z: Column) -> Column:
        far = F.concat(F.lit(f"- {name}: "), value.cast("string"), F.lit(" ("), F.when(z > 0, "+").otherwise(""), F.format_string("%.1f", z), F.lit(" std vs "), observed, F.lit(" baseline)"))
        return F.when(F.coalesce(F.abs(z) > DEVIATION, F.lit(False)), far).otherwise(F.concat(F.lit(f"- {name}: "), value.cast("string"), F.lit(" (within expected)")))

    return F.when((predicted != observed) | notable, F.concat_ws("\n", header, *[line(n, v, z) for n, (v, z) in signals.items()]))


def lenses(feeling: Column) -> Column:
    """Names of the lenses that fit a feeling, as an array; null for an unknown one."""
    out = F.lit(None).cast("array<string>")
    for name, found in LENSES.items():
        out = F.when(feeling == name, F.array(*[F.lit(x) for x in found]).cast("array<string>")).otherwise(out)
    return out


def self_empathy(feeling: Column, pulses: Column) -> Column:
    """Questions about a feeling through its lenses; null where it has none."""
    has = lambda lens: F.array_contains(lenses(feeling), lens)
    checks = "- CBT lens: What thought pattern is active? Check for:\n" + "\n".join(f"  - {name}: {text}" for name, text in DISTORTIONS.items())
    return F.when(
        F.size(lenses(feeling)) > 0,
        F.concat_ws(
            "\n",
            F.concat(F.lit("Self-empathy check ("), feeling, F.lit(" for "), pulses.cast("string"), F.lit(" pulses):")),
            F.when(has("cbt"), checks),
            F.when(has("pct"), "- PCT lens: What's the honest felt-sense, without performance?"),
            F.when(has("rt"), "- RT lens: What's the specific obstacle? What action would help?"),
            F.lit(""),
            F.lit("You may address this directly or let it inform your work."),
        ),
    )


def drive_text(levels: dict[str, Column], since: dict[str, Column]) -> Column:
    """Drives at or over their thresholds, with how strong they are and, if pulses have passed, for want of what."""
    want = {
        "building": lambda n: F.concat(F.lit(" — no code changes in "), n.cast("string"), F.lit(" pulses")),
        "publishing": lambda _: F.lit(" — good written material accumulating without outlet"),
        "experimenting": lambda _: F.lit(" — curiosity high but channeling into reflection, not experiment"),
    }
    lines = []
    for name, (description, threshold) in DRIVES.items():
        level, n = levels[name], since[name]
        strength = F.when(level < STRONG, "elevated").otherwise("strong")
        context = F.concat(strength, F.when(n > 0, want[name](n)).otherwise(""))
        lines.append(F.when(level >= threshold, F.concat(F.lit(f"- {description}: "), F.format_string("%.2f", level), F.lit(" ("), context, F.lit(")"))))
    told = F.concat_ws("\n", *lines)
    return F.when(told != "", F.concat(F.lit("Drive states:\n"), told, F.lit("\n\nThese are internal pressures, not instructions. Notice them or don't.")))


def injection(error: Column, feeling: Column, confidence: Column, pulses: Column, drives: Column) -> Column:
    """The whole block: the prediction error, a feeling that lasts and is sure (not neutral) with what it affords and
    asks, and the drives; null where there is nothing to tell."""
    lasting = (confidence >= 0.5) & (pulses >= 2) & (feeling != "neutral")
    offered = affordances(feeling)
    parts = [
        error,
        F.when(lasting, F.concat(F.lit("\nFeeling state: "), feeling, F.lit(" ("), pulses.cast("string"), F.lit(" pulses)"))),
        F.when(lasting & (offered != ""), F.concat(F.lit("Affordances available: "), offered)),
        F.when(lasting, F.concat(F.lit("\n"), self_empathy(feeling, pulses))),
        F.concat(F.lit("\n"), drives),
    ]
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def dynamic_sections(prompt: Column, name: str) -> Column:
    """The parts of a prompt that change, each up to a rule or the end, trimmed, line by line; the rest is left out.

    ``name`` is whose instructions open the first part.
    """
    opens = [rf"\Q{name}\E left specific instructions.*?:", *SECTIONS.values()]
    found = [F.regexp_extract(prompt, rf"(?s){p}\n(.+?)(?:\n---|\z)", 1) for p in opens]
    plain = [F.nullif(F.regexp_replace(f, r"(?U)^\s+|\s+\z", ""), F.lit("")) for f in found]
    return F.concat_ws("\n", *plain)


def standalone_plan(messages: DataFrame, key: str, issues: Column, files: Column, feeling: Column, queries: dict[str, list[str]], most: int = 8) -> DataFrame:
    """(key, place, query, origin) of a message outside a run: its references, then queries of the current feeling."""
    asked = F.array().cast("array<string>")
    for name, texts in queries.items():
        asked = F.when(feeling == name, F.array(*[F.lit(t) for t in texts])).otherwise(asked)
    named = lambda refs, origin: F.transform(refs, lambda q: F.struct(q.alias("query"), origin.alias("origin")))
    every = F.concat(named(issues, F.lit("issue-ref")), named(files, F.lit("file-ref")), named(asked, F.concat(F.lit("feeling: "), feeling)))
    rows = messages.select(key, F.posexplode(F.slice(F.coalesce(every, F.concat(named(issues, F.lit("issue-ref")), named(files, F.lit("file-ref")))), 1, most)).alias("_p", "_q"))
    return rows.select(key, (F.col("_p") + 1).alias("place"), "_q.query", "_q.origin")


def shortened_path(path: Column, root: str) -> Column:
    """A path under the root without it; of any other path the last part."""
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 2), F.lit(1 << 20))).otherwise(F.substring_index(path, "/", -1))


def pointer_line(query: Column, path: Column, count: Column, hint: Column, origin: Column) -> Column:
    """One pointer: query (cut at 80), best path, how many more, a hint and where the query came from."""
    shown = F.when(F.char_length(query) > 80, F.concat(F.substring(query, 1, 80), F.lit("..."))).otherwise(query)
    more = F.when(count > 1, F.concat(F.lit(" (+"), (count - 1).cast("string"), F.lit(" more)"))).otherwise("")
    told = F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("\n  *"), hint, F.lit("*"))).otherwise("")
    source = F.when(F.coalesce(origin, F.lit("")) != "", F.concat(F.lit(" ["), origin, F.lit("]"))).otherwise("")
    return F.concat(F.lit('- `"'), shown, F.lit('"` → `'), path, F.lit("`"), more, told, source)


def rated(answer: Column) -> Column:
    """The number after ``SCORE:`` in a model's answer, or null."""
    return F.nullif(F.regexp_extract(answer, r"SCORE:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def combined_score(own: Column, given: Column) -> Column:
    """The mean of the own score and a given one; the own one if none was given."""
    return F.when(given.isNotNull(), (own + given) / 2).otherwise(own)
