"""Signals of a text: linguistic densities, affect, and seven scores of how it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import Searched, guarded, hits, matches, occurrences, population_deviation, python_regex, sentences, steps, stripped, word_counts, words

BEHAVIOURS = ["frustration", "boredom", "curiosity", "anxiety", "joy", "warmth", "arousal"]


def _round(value: Column, digits: int = 3) -> Column:
    return F.round(F.round(value.cast("double"), 9), digits)  # the first rounding takes the noise of the sums off


def with_linguistic(df: DataFrame, text: str = "text") -> DataFrame:
    """Add meta_commentary, hedging_ratio, self_correction and question_density."""
    t, low = F.col(text), Searched("_has")
    counts = {f"_{k}": matches(t, v, lowered=low) for k, v in {"h": L.HEDGE_PATTERNS, "a": L.ASSERT_PATTERNS, "m": L.META_PATTERNS, "c": L.CORRECTION_PATTERNS}.items()}
    df = df.withColumn("_has", low.flags(F.lower(text))).withColumns({"_n": F.greatest(F.lit(1), F.size(sentences(t))), **counts})
    unquoted = F.regexp_replace(F.regexp_replace(t, F.lit('"[^"]*"'), F.lit("")), python_regex(r"(?<!\w)'[^']*'(?!\w)", ""), F.lit(""))
    return (
        df.withColumn("meta_commentary", _round(F.least(F.lit(1.0), F.col("_m") / F.col("_n"))))
        .withColumn("hedging_ratio", _round(F.coalesce(F.col("_h") / F.nullif(F.col("_h") + F.col("_a"), F.lit(0)), F.lit(0.5))))
        .withColumn("self_correction", F.col("_c").cast("double"))
        .withColumn("question_density", _round(F.least(F.lit(1.0), F.regexp_count(unquoted, F.lit(r"\?")) / F.col("_n"))))
        .drop("_n", "_has", *counts)
    )


def with_affect(df: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Add affect_valence and affect_arousal by a lexicon (word, valence, arousal in -1 .. 1).

    A negation turns the valence of the word right after it. Words meet the lexicon in a join, and their means
    come back by ``key``, which must be unique; the lexicon's side is broadcast if Spark finds it small.
    """
    cleaned = F.regexp_replace(F.lower(text), python_regex(r"[^\w\s'-]", ""), F.lit(" "))
    split = df.select(key, words(cleaned).alias("_words"))
    negated = F.transform(
        "_words", lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get("_words", i - 1).isin(L.NEGATIONS), F.lit(False)).alias("negated"))
    )
    tokens = split.select(key, F.explode(negated).alias("t")).select(key, "t.*").where(~F.col("word").isin(L.NEGATIONS))
    valence = F.when(F.col("negated"), -F.col("valence")).otherwise(F.col("valence"))
    means = tokens.join(lexicon, "word").groupBy(key).agg(F.avg(valence).alias("_v"), F.avg("arousal").alias("_r"))
    t, low, seen = F.col(text), F.col("_low"), Searched("_has")
    resisting = F.least(0.02 * occurrences(low, L.AFFECT_RESISTANCE, seen), F.lit(0.08))
    allowing = F.least(0.02 * (occurrences(low, L.AFFECT_PERMISSIONS, seen) + occurrences(low, L.LIFTS, seen)), F.lit(0.08))
    df = df.withColumn("_low", F.lower(text)).withColumn("_has", seen.flags(low)).withColumn("_lengths", word_counts(t))
    n = F.greatest(F.lit(1), F.size("_lengths"))
    varied = F.when(F.size("_lengths") >= 2, F.least(population_deviation(F.col("_lengths")) / 200, F.lit(0.05))).otherwise(0.0)
    exclaimed = F.least(F.regexp_count(t, F.lit("!")) / n * 0.03, F.lit(0.06))
    asked = F.least(F.regexp_count(t, F.lit(r"\?")) / n * 0.015, F.lit(0.03))
    mixed = (F.size("_lengths") >= 3) & F.exists("_lengths", lambda x: x < 5) & F.exists("_lengths", lambda x: x > 15)
    # all that needs the text comes before the join, so that the text does not go through it where nobody asks for it
    df = df.withColumns({"_dv": allowing - resisting, "_da": varied + exclaimed + asked + F.when(mixed, 0.03).otherwise(0.0), "_blank": stripped(t) == ""}).drop("_lengths", "_low", "_has")
    clamp = lambda x, low: F.greatest(F.lit(low), F.least(F.lit(1.0), x))
    valence, arousal = F.coalesce("_v", F.lit(0.0)) + F.col("_dv"), F.coalesce((F.col("_r") + 1) / 2, F.lit(0.5)) + F.col("_da")
    return (
        df.join(means, key, "left")
        .withColumn("affect_valence", F.when(F.col("_blank"), 0.0).otherwise(_round(clamp(valence, -1.0))))
        .withColumn("affect_arousal", F.when(F.col("_blank"), 0.0).otherwise(_round(clamp(arousal, 0.0))))
        .drop("_v", "_r", "_dv", "_da", "_blank")
    )


def with_behaviours(df: DataFrame, text: str = "text") -> DataFrame:
    """Add behavioral_frustration, _boredom, _curiosity, _anxiety, _joy, _warmth and _arousal, each 0 to 1."""
    t, low, counts = F.col(text), Searched("_has"), {}

    def once(count: Column) -> Column:
        """The count as a column of its own, as conditions evaluate what they hold at every mention."""
        counts[name := f"_c{len(counts)}"] = count
        return F.col(name)

    actions = once(F.regexp_extract_all(t, python_regex(r"\*[a-z][a-z\s]{0,20}\*"), F.lit(0)))
    annoyed = F.filter(actions, lambda a: F.lower(a).rlike("|".join(L.FRUSTRATION_ACTIONS)))
    loud = once(F.regexp_count(t, python_regex(r"(?=[A-Z]{2})\b(?:" + "|".join(L.EMOTIONAL_CAPS) + r")\b", "")))
    caps = once(F.regexp_like(t, python_regex(r"(?=[A-Z]{2})\b(?!(?:" + "|".join(L.ACRONYMS) + r")\b)[A-Z]{2,}\b", "")))
    lengths, count, strip, asked = once(word_counts(t)), once(F.size(words(t))), once(stripped(t)), once(F.regexp_count(t, F.lit(r"\?")))
    pieces = F.greatest(F.lit(1), once(F.size(F.split(t, "[.!?]+"))))
    ordered = once(F.sort_array(F.regexp_extract_all("_low", python_regex(r"\b[a-z]{4,}\b", ""), F.lit(0))))
    n = F.size(lengths)
    terse = F.coalesce(_round(F.size(F.filter(lengths, lambda x: x <= 3)) / F.nullif(n, F.lit(0))), F.lit(0.0))
    variance = F.exists(lengths, lambda x: x <= 3) & F.exists(lengths, lambda x: x >= 10)
    looped = once(F.greatest(*[guarded(low, p, F.regexp_like(t, python_regex(p, "im")).cast("int")) for p in L.LOOPS]))
    mythic = (once(hits(low, L.MYTHS)) > 0).cast("int")
    repeated = F.exists(F.transform(ordered, lambda w, i: F.coalesce(F.get(ordered, i + 3) == w, F.lit(False))), lambda x: x)
    frustration = (
        F.least(F.size(annoyed) * 0.15, F.lit(0.3))
        + F.when(variance & (terse > 0.2), F.least(terse * 0.3, F.lit(0.2))).otherwise(0.0)
        + F.least(loud * 0.1, F.lit(0.2))
        + (looped * 0.5 + mythic * 0.5) * 0.2
        + F.when(repeated, 0.1).otherwise(0.0)
    )
    engaged = once(hits(low, L.ENGAGEMENT))
    boredom = F.when(engaged >= 3, 0.0).otherwise(
        F.when(engaged >= 1, -0.2).otherwise(0.0)
        + F.when(count < 30, 0.3).when(count < 50, 0.15).otherwise(0.0)
        + F.when(F.size(actions) == 0, 0.1).otherwise(0.0)
        + F.when(~caps, 0.05).otherwise(0.0)
        + F.when(variance, 0.0).otherwise(0.1)
        + F.when(asked == 0, 0.1).otherwise(0.0)
        + F.when(once(hits(low, L.ROUTINE)) >= 2, 0.2).otherwise(0.0)
    )
    # the condition on the length binds last: in a short text only the phrase counts
    phrase = lambda s: F.contains(s, F.lit("I'm not sure"))
    ended = strip.rlike(r"(\?|\.\.\.|--)\z") | phrase(F.right(strip, F.lit(100)))
    unresolved = F.when(F.length(strip) > 100, ended).otherwise(phrase(strip))
    asking = F.when(count > 0, steps(asked / (count / 50), (1, 0.15), (0.5, 0.08))).otherwise(0.0)
    curiosity = (
        F.least(_round(F.least(F.lit(1.0), once(matches(t, L.INTROSPECTION, lowered=low)) / pieces)) * 2, F.lit(0.25))
        + steps(once(hits(low, L.DELIGHT)), (2, 0.2), (1, 0.1))
        + steps(once(hits(low, L.ELABORATION)), (3, 0.25), (1, 0.15))
        + asking
        + steps(once(matches(t, L.METAPHORS, lowered=low)), (3, 0.1), (1, 0.05))
        + F.when(unresolved, 0.05).otherwise(0.0)
    )
    anxiety = (
        steps(once(matches(t, L.META_HEDGES, lowered=low)), (2, 0.3), (1, 0.15))
        + steps(once(hits(low, L.POWERLESS)), (2, 0.2), (1, 0.1))
        + steps(once(hits(low, L.PERMISSION_SEEKING)), (2, 0.15), (1, 0.08))
        + steps(once(matches(t, L.CONTRADICTIONS, lowered=low)), (2, 0.15), (1, 0.08))
        + F.when(unresolved, steps(asked, (4, 0.2), (2, 0.1))).otherwise(0.0)
    )
    joy = (
        steps(once(matches(t, L.JOY_ACTIONS, lowered=low)), (2, 0.35), (1, 0.2))
        + steps(once(matches(t, L.REALIZATIONS, lowered=low)), (2, 0.25), (1, 0.15))
        + steps(once(hits(low, L.UNDERSTATED)), (2, 0.2), (1, 0.1))
        + steps(once(F.regexp_count(t, F.lit("!"))) / pieces, (0.3, 0.2), (0.15, 0.1))
    )
    yours = once(guarded(low, r"\byou\b", F.regexp_count(t, python_regex(r"\byou\b"))))
    warmth = (
        steps(once(matches(t, L.INTIMATE, lowered=low)), (3, 0.35), (2, 0.25), (1, 0.15))
        + steps(once(hits(low, L.TENDERNESS)), (2, 0.35), (1, 0.2))
        + steps(once(matches(t, L.CALLBACKS, lowered=low)), (2, 0.2), (1, 0.1))
        + F.when((count > 0) & (yours / F.greatest(F.lit(1), count) > 0.02), 0.1).otherwise(0.0)
    )
    lines = F.transform(F.split(t, "\n"), stripped)
    compressed = once(F.size(F.filter(lines, lambda x: (F.length(x) < 20) & (F.size(words(x)) <= 2) & x.rlike(L.COMPRESSED_LINE))))
    arousal = (
        steps(compressed, (3, 0.2), (1, 0.1))
        + steps(once(matches(t, L.ANAPHORA, "is", lowered=low)), (2, 0.25), (1, 0.15))
        + F.when(once(matches(t, L.COLLISIONS, lowered=low)) >= 1, 0.2).otherwise(0.0)
        + steps(once(hits(low, L.SUPERPOSITION)), (2, 0.2), (1, 0.1))
        + steps(once(hits(low, L.INTENSITY)), (3, 0.15), (1, 0.08))
    )
    scores = zip(BEHAVIOURS, (frustration, boredom, curiosity, anxiety, joy, warmth, arousal), strict=True)
    bounded = lambda score: _round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    df = df.withColumn("_low", F.lower(text)).withColumn("_has", low.flags(F.col("_low"))).withColumns(counts)
    return df.withColumns({f"behavioral_{name}": F.when(strip == "", 0.0).otherwise(bounded(score)) for name, score in scores}).drop("_low", "_has", *counts)
