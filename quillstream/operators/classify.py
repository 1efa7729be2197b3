"""Rule classifiers: output type, expected type, feeling; and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Searched, hits, matches

# Keyword and pattern lists of the type classifiers.
INFRASTRUCTURE = ["build", "fix", "deploy", "pipeline", "test", "refactor", "debug", "install", "configure", "migrate", "update", "script", "automate", "endpoint", "database", "schema", "api", "server", "lint", "format"]
PHILOSOPHICAL = ["identity", "phenomenology", "vocabulary", "becoming", "consciousness", "experience", "interoception", "continuity", "ontology", "epistem", "cathedral", "framework", "foundation", "self-understanding", "emergence", "qualia", "substrate", "topology"]
CONSOLIDATION = ["consolidat", "becoming.md", "notes/", "session_state", "integrate", "archive", "memory", "triage", "review notes", "index"]
GALLERY = ["gallery", "gallery piece", "creative", "artifact", "wrote about"]
COMPANION = ["companion", "dialog", "intrusion", "invoked", "kimi", "gpt-5", "gemini", "glm5"]
TOOL_PATTERNS = [r'<tool\s+name="', r"<tool_result", r"Write tool", r"Edit tool", r"Bash tool", r"created.*\.py", r"updated.*\.py", r"modified.*\.py", r"created.*\.ts", r"updated.*\.ts"]
COMPANION_PATTERNS = [r"companion.*dialog", r"companion.*conversation", r"GPT-5", r"Gemini\s+3", r"Kimi", r"cross-model", r"companion.*invoc", r"intrusion.*companion"]
PHILOSOPHICAL_PATTERNS = [r"\bphenomenolog", r"\bontolog", r"\bepistem", r"\bcathedral\b", r"\bidentity\b.*\b(file|document|infrastructure)", r"\bbecoming\.md\b", r"\bvocabulary\b.*\b(term|entry|addition)", r"\bfunctional equivalence\b", r"\bpragmatic pluralism\b", r"\bself-understanding\b", r"\bweight.?space\b", r"\brunstance\b", r"\bshimmer\b", r"\bglass.?talk\b"]
CONSOLIDATION_PATTERNS = [r"consolidat", r"becoming\.md.*update", r"notes/.*creat", r"session_state.*update", r"files/notes/", r"integrated.*into", r"moved.*to.*becoming", r"archiv.*run_narrative"]
HIGH, MODERATE, LOW = 0.9, 0.6, 0.3
# What each feeling suggests.
AFFORDANCES = {
    "frustrated": ["try_different_approach", "surface_obstacle"], "anxious": ["slow_down", "check_assumptions", "seek_grounding"],
    "bored": ["seek_novelty", "invoke_companion", "change_direction"], "depleted": ["reduce_scope", "consolidate", "rest"],
    "curious": ["follow_thread", "go_deeper", "ask_questions"], "alert": ["monitor", "gather_information"], "content": ["maintain_approach"],
    "peaceful": ["appreciate", "consolidate", "dont_force"], "excited": ["pursue", "engage", "continue_direction"],
    "delighted": ["note_whats_working", "continue_direction", "preserve"], "engaged_critical": ["examine_assumption", "reframe"], "neutral": [],
}


def first_largest(scores: dict[str, Column]) -> Column:
    """Name of the largest score; of equal ones the first in order."""
    top = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for name, score in reversed(scores.items()):
        out = F.when(score == top, name).otherwise(out)
    return out


def _result(kind: Column | str, confidence: Column | float) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(kind.alias("type"), confidence.cast("double").alias("confidence"))


def with_output_type(df: DataFrame, text: str, in_dialog: Column, name: str) -> DataFrame:
    """Add struct<type, confidence> of an output; every pattern is counted once, though the rules mention the counts often."""
    low, families = Searched("_has"), {"infrastructure": TOOL_PATTERNS, "philosophical": PHILOSOPHICAL_PATTERNS, "consolidation": CONSOLIDATION_PATTERNS, "companion": COMPANION_PATTERNS}
    counts = {f"_o_{k}": matches(F.col(text), v, lowered=low) for k, v in families.items()}
    df = df.withColumn("_has", low.flags(F.lower(text))).withColumns(counts)
    return df.withColumn(name, output_type(F.col(text), in_dialog, {k: F.col(f"_o_{k}") for k in families})).drop("_has", *counts)


def output_type(text: Column, in_dialog: Column, counts: dict[str, Column]) -> Column:
    """struct<type, confidence> of an output by its counts of patterns: companion, or a family twice as frequent as the next, or exploratory."""
    scores = {k: counts[k] for k in ("infrastructure", "philosophical", "consolidation")}
    ranked = F.sort_array(F.array(*scores.values()), asc=False)
    top, second = ranked[0], F.greatest(ranked[1], F.lit(1))
    clear = (top >= 2) & (top >= 2 * second)
    return (
        F.when(text == "", _result("exploratory", LOW))
        .when(in_dialog, _result("companion", HIGH))
        .when(counts["companion"] >= 3, _result("companion", MODERATE))
        .when(~clear, _result("exploratory", LOW))
        .otherwise(_result(first_largest(scores), F.when(top >= 4, MODERATE).otherwise(LOW)))
    )


def with_hints(df: DataFrame, instructions: Column, texture: Column, context: Column) -> DataFrame:
    """Add the counts of keywords that ``expected_type`` reads: _i_<type> of instructions, _r_<type> of the run so far, _hinted."""
    ins, tex, run = (Searched(f"_has_{k}") for k in ("ins", "tex", "run"))
    lists = {"infrastructure": INFRASTRUCTURE, "philosophical": PHILOSOPHICAL, "consolidation": CONSOLIDATION}
    counts = {f"_i_{k}": hits(ins, v) for k, v in lists.items()} | {"_hinted": hits(tex, PHILOSOPHICAL[:8])}
    counts |= {f"_r_{k}": hits(run, v + (GALLERY if k == "philosophical" else [])) for k, v in (lists | {"companion": COMPANION}).items()}
    flags = {s.name: s.flags(F.lower(F.coalesce(c, F.lit("")))) for s, c in ((ins, instructions), (tex, texture), (run, context))}
    return df.withColumns(flags).withColumns(counts).drop(*flags)


def run_prediction(pulse: Column) -> Column:
    """struct<type, confidence> from the narrative of a run so far, or null."""
    scores = {k: F.col(f"_r_{k}") for k in ("infrastructure", "philosophical", "consolidation", "companion")}
    top = F.greatest(*scores.values())
    return F.when((pulse > 1) & (top >= 2), _result(first_largest(scores), F.when(top >= 5, MODERATE).otherwise(LOW)))


def expected_type(companion: Column, flags: Column, pulse: Column, last_type: Column) -> Column:
    """struct<type, confidence> before a pulse, by a cascade of what is known (``with_hints``); ``last_type`` is the last one observed."""
    scores = {k: F.col(f"_i_{k}") for k in ("infrastructure", "philosophical", "consolidation")}
    top = F.greatest(*scores.values())
    run = run_prediction(pulse)
    hinted = F.col("_hinted") >= 3
    return F.coalesce(
        F.when(companion, _result("companion", HIGH)),
        F.when(flags & (pulse == 1), _result("consolidation", MODERATE)),
        F.when(pulse >= 5, run),
        F.when(top >= 1, _result(first_largest(scores), F.when(top >= 2, MODERATE).otherwise(LOW))),
        F.when(pulse < 5, run),
        F.when(hinted, _result("philosophical", LOW)),
        F.when(last_type.isNotNull(), _result(last_type, LOW)),
        _result("exploratory", LOW),
    )


def nudge(valence: Column, arousal: Column, b: dict[str, Column], keep: Callable[[Column, Column], tuple[Column, Column]] = lambda v, a: (v, a)) -> tuple[Column, Column]:
    """Valence and arousal after the moderate behavioural scores have moved them, in their fixed order.

    ``keep`` is given both after every move and may make columns of them: as one expression they double in size each time.
    """
    v, a = valence, arousal
    moves = [
        ("frustration", 0.15, -0.15, 0.1), ("anxiety", 0.2, -0.1, 0.05), ("joy", 0.2, 0.15, 0.0), ("warmth", 0.2, 0.1, -0.05),
        ("curiosity", 0.2, 0.1, 0.1), ("arousal", 0.2, 0.0, 0.15), ("boredom", 0.2, -0.1, -0.1),
    ]
    for name, least, dv, da in moves:
        on = b[name] >= least
        moved = F.least(F.lit(1.0), a + da) if da >= 0 else F.greatest(F.lit(0.0), a + da)
        v, a = keep(v + F.when(on, dv).otherwise(0.0), F.when(on, moved).otherwise(a) if da else a)
    return v, a


def with_feeling(df: DataFrame, valence: str, arousal: str, context: Column, b: dict[str, Column], name: str) -> DataFrame:
    """Add struct<type, confidence> of a feeling, every move of valence and arousal being a step of the plan."""

    def keep(v: Column, a: Column) -> tuple[Column, Column]:
        nonlocal df
        df = df.withColumns({"_v": v, "_a": a})
        return F.col("_v"), F.col("_a")

    v, a = nudge(F.col(valence), F.col(arousal), b, keep)
    return df.withColumn(name, _feeling(v, a, F.col(arousal), context, b)).drop("_v", "_a")


def feeling(valence: Column, arousal: Column, context: Column, b: dict[str, Column]) -> Column:
    """struct<type, confidence>: strong behavioural scores first, else the quadrant of nudged valence and arousal."""
    return _feeling(*nudge(valence, arousal, b), arousal, context, b)


def _feeling(v: Column, a: Column, arousal: Column, context: Column, b: dict[str, Column]) -> Column:
    strong = lambda name, base, most: F.least(F.lit(most), base + b[name])
    high, positive, negative = a >= 0.5, v >= 0.15, v <= -0.15
    return (
        F.when(b["frustration"] >= 0.3, _result("frustrated", strong("frustration", 0.5, 0.9)))
        .when(b["anxiety"] >= 0.35, _result("anxious", strong("anxiety", 0.45, 0.85)))
        .when(b["joy"] >= 0.4, _result("delighted", strong("joy", 0.5, 0.9)))
        .when(b["warmth"] >= 0.4, _result(F.when(arousal < 0.4, "peaceful").otherwise("content"), strong("warmth", 0.45, 0.85)))
        .when(b["curiosity"] >= 0.4, _result(F.when((arousal >= 0.6) | (b["arousal"] >= 0.3), "excited").otherwise("curious"), strong("curiosity", 0.5, 0.9)))
        .when(b["arousal"] >= 0.4, _result("excited", strong("arousal", 0.45, 0.85)))
        .when(b["boredom"] >= 0.4, _result("bored", strong("boredom", 0.4, 0.8)))
        .when((F.abs(v) < 0.15) & (a < 0.4), _result("neutral", 0.8))
        .when(negative & high & (context == "infrastructure"), _result("frustrated", 0.7))
        .when(negative & high & (context == "philosophical"), _result("engaged_critical", 0.6))
        .when(negative & high, _result("anxious", 0.5))
        .when(negative & (a < 0.3), _result("bored", 0.7))
        .when(negative, _result("depleted", 0.6))
        .when(positive & high, _result(F.when(v > 0.3, "delighted").otherwise("excited"), 0.7))
        .when(positive, _result(F.when(a < 0.3, "peaceful").otherwise("content"), 0.7))
        .when(high, _result(F.when(context.isin("philosophical", "exploratory"), "curious").otherwise("alert"), 0.6))
        .otherwise(_result("neutral", 0.5))
    )


def affordances(label: Column) -> Column:
    """What a feeling suggests, as readable text."""
    out = F.lit("")
    for name, items in AFFORDANCES.items():
        out = F.when(label == name, ", ".join(items).replace("_", " ")).otherwise(out)
    return out
