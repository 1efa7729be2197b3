"""Quality rules as weak supervision: votes, EM accuracies and posteriors (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
#: Frequent function words of the four languages, for the prose rule.
FUNCTION_WORDS = (
    "the of and to in is that for was with on are as by this from at it "
    "der die das und den von zu mit ist im nicht auf für eine "
    "le la les des et en est une dans qui que pour au "
    "el los las y del se por con una para su"
).split()


@dataclass(frozen=True)
class Rule:
    """A rule votes good where ``good`` holds, else bad where ``bad`` holds, else abstains.

    Both are integer arithmetic over the counts of ``with_counts``, in SQL that other engines read alike.
    """

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_length", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    Rule("dup_lines", "n_dup_lines = 0", "10 * n_dup_lines >= 3 * n_lines"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("capitals", "100 * n_upper <= 15 * word_chars", "10 * n_upper >= 4 * word_chars"),
    Rule("exclaimed", "50 * n_bangs <= n_words", "10 * n_bangs >= n_words"),
    Rule("digits", "20 * n_digits <= word_chars", "5 * n_digits >= word_chars"),
    Rule("prose", "20 * n_function >= n_words", "100 * n_function < n_words"),
)
ITERATIONS = 12
#: Start of the share of good texts and of a rule's two accuracies (right votes on good, on bad texts); a bad
#: text fails some rules only, so the second starts low. Bounds keep every parameter away from 0 and 1.
START_SHARE, START_GOOD, START_BAD = 0.8, 0.99, 0.15
LOW, HIGH = 0.001, 0.999
#: Pseudo-votes behind the start values, as a share of all texts: they keep the two classes from turning into
#: some other split of the corpus, such as short and long texts.
PRIOR = 0.1


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the integer counts of every whole text; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    split = docs.select("doc_id", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    split = split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # a window's 64-bit hash over the hashes of its words stands for it; only texts with a repeated one are sorted further
    windows = F.when(
        F.size("_hashes") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("_hashes") - WINDOW),
            lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]),
        ),
    )
    counted = split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        (F.char_length("_text") - F.regexp_count("_text", F.lit(r"[ \t-\r]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size(F.filter("_words", lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        windows.alias("_windows"),
    )
    repeated = counted.withColumn(
        "_windows", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows"))
    )
    ranked = repeated.withColumn(
        "_sorted", F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    ).drop("_windows")
    found = ranked.withColumn(
        "_at",
        F.sort_array(
            F.transform(
                F.filter(
                    "_sorted",
                    lambda e, i: (F.coalesce(e["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)))
                    | (F.coalesce(e["h"] == F.get("_sorted", i + 1)["h"], F.lit(False))),
                ),
                lambda e: e["at"],
            )
        ),
    ).drop("_sorted")
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def vote(rule: Rule) -> str:
    return f"CASE WHEN {rule.good} THEN 1 WHEN {rule.bad} THEN -1 ELSE 0 END"


def bounded(value: float) -> float:
    return min(HIGH, max(LOW, value))


def posterior_sql(share: float, accuracies: list[tuple[float, float]]) -> str:
    """Probability of the class good given the votes, independent within a class; abstaining tells nothing.

    A vote never counts against what it says: its weight is 0 where the estimates would turn it round.
    """
    terms = [f"{log(share / (1 - share))!r}D"]
    for j, (good, bad) in enumerate(accuracies):
        up, down = max(0.0, log(good / (1 - bad))), min(0.0, log((1 - good) / bad))
        terms.append(f"CASE v{j} WHEN 1 THEN {up!r}D WHEN -1 THEN {down!r}D ELSE 0D END")
    return f"1D / (1D + exp(-({' + '.join(terms)})))"


def fit(votes: DataFrame, rules: int = len(RULES), iterations: int = ITERATIONS) -> tuple[float, list[tuple[float, float]]]:
    """EM over the counts of distinct vote patterns (3^rules at most): the share of good texts and accuracies."""
    names = [f"v{j}" for j in range(rules)]
    patterns = stored(votes.groupBy(*names).agg(F.count("*").alias("c")).coalesce(1))
    share, accuracies = START_SHARE, [(START_GOOD, START_BAD)] * rules
    for _ in range(iterations):
        good = F.col("c") * F.expr(posterior_sql(share, accuracies))
        sums = [F.sum(good).alias("good"), F.sum("c").alias("all")]
        for name in names:
            for label, sign in (("up", 1), ("down", -1)):
                voted = F.col(name) == sign
                sums.append(F.sum(F.when(voted, good).otherwise(0)).alias(f"good_{label}_{name}"))
                sums.append(F.sum(F.when(voted, F.col("c") - good).otherwise(0)).alias(f"bad_{label}_{name}"))
        row = patterns.agg(*sums).first()
        if not row["all"]:
            break
        share = bounded(row["good"] / row["all"])
        accuracies = []
        for name in names:
            pseudo = PRIOR * row["all"]
            on_good, on_bad = (row[f"{k}_up_{name}"] + row[f"{k}_down_{name}"] for k in ("good", "bad"))
            accuracies.append(
                (
                    bounded((row[f"good_up_{name}"] + pseudo * START_GOOD) / (on_good + pseudo)),
                    bounded((row[f"bad_down_{name}"] + pseudo * START_BAD) / (on_bad + pseudo)),
                )
            )
    return share, accuracies


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Counts, base filter and the posterior probability of being good, for every row of ``docs``.

    Texts are read once: the counts are stored, the accuracies estimated from all of them, and the verdict is
    a projection of the counts. A null, empty or blank text has zero counts and fails the base filter; repeated
    rows and ties get equal verdicts; an empty table gives an empty result; extra columns are ignored.
    """
    counts = stored(with_counts(docs))
    votes = counts.select("*", *[F.expr(vote(r)).alias(f"v{j}") for j, r in enumerate(rules)])
    share, accuracies = fit(votes, len(rules))
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    probability: Column = F.expr(posterior_sql(share, accuracies))
    judged = votes.withColumn("base_failed", base).withColumn("quality", probability)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"),
        F.round("quality", 6).alias("quality"),
    )
