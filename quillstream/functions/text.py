"""Column expressions over texts: token hits, pattern counts, sentences. All but ``Searched`` stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


SENTENCE_END = r"(?dU)[.!?]+(?:\s|$)"


def python_regex(pattern: str, flags: str = "i") -> Column:
    """A pattern written for Python's ``re``, with Java flags that give it the same classes and line ends."""
    return F.lit(f"(?dU{flags}){pattern}")


def total(parts: list[Column]) -> Column:
    return reduce(add, parts) if parts else F.lit(0)


class Searched:
    """A lower-case text in which many literals are looked for at once.

    ``has`` refers to a column ``name`` of flags, one a literal; ``flags``, taken once all expressions are written, gives
    that column. Python's search for a literal is many times as fast as the JVM's, so texts go there once, in Arrow batches.
    """

    def __init__(self, name: str) -> None:
        self.name, self.places = name, {}

    def has(self, literal: str) -> Column:
        return F.get(F.col(self.name), F.lit(self.places.setdefault(literal, len(self.places))))

    def flags(self, lowered: Column) -> Column:
        literals = list(self.places)

        def search(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else [literal in t for literal in literals] for t in (x.as_py() for x in texts)], pa.list_(pa.bool_()))

        return F.arrow_udf(search, "array<boolean>")(lowered)


def has(lowered: Column | Searched, literal: str) -> Column:
    return lowered.has(literal) if isinstance(lowered, Searched) else F.contains(lowered, F.lit(literal))


def hits(lowered: Column | Searched, tokens: list[str]) -> Column:
    """Number of tokens that occur in a lower-case text, as substrings."""
    return total([has(lowered, t).cast("int") for t in tokens])


def occurrences(lowered: Column, tokens: list[str], searched: Searched | None = None) -> Column:
    """Number of non-overlapping occurrences of all tokens; with ``searched``, only those that the text has are counted."""
    each = [((F.length(lowered) - F.length(F.replace(lowered, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in tokens]
    return total(each if searched is None else [F.when(~searched.has(t), 0).otherwise(c) for t, c in zip(tokens, each, strict=True)])


def needed_literal(pattern: str) -> str:
    """The longest lower-case text that everything a pattern matches contains; empty if there is none.

    Groups, classes, wildcards and optional characters are left out, so that what remains must occur as it stands.
    """
    plain = re.sub(r"\\[bBsSdDwWnrtfAzZ]", "\0", pattern)
    while re.search(r"\([^()]*\)", plain):
        plain = re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", "\0", plain)
    plain = re.sub(r"\\(.)", lambda m: chr(0xE000 + ord(m[1])), plain)
    plain = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?", "\0", plain)
    if "|" in plain:
        return ""
    plain = re.sub(r".(?:[?*]|\{[^}]*\})", "\0", plain)
    parts = re.split(r"[\0.^$+]", plain)
    return max(("".join(chr(ord(c) - 0xE000) if 0xE000 <= ord(c) < 0xE080 else c for c in p) for p in parts), key=len).lower()


def needed_literals(pattern: str) -> list[str]:
    """Texts one of which everything a pattern matches contains: its longest literal, else what it begins with and the plain choices of its first group.

    A group that is there twice or more is there at least once, so what it begins with is needed too.
    """
    literal, char = needed_literal(pattern), r"[^()|\\\[\].?*+{}^$]"
    if len(literal) > 1 or literal and not literal.isalnum():
        return [literal]
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return []
    first = re.match(rf"(?:\\b)?({char}*)\(({char}+(?:\|{char}+)*)\)(?![?*{{])", pattern)
    if first:
        return [(first[1] + choice).lower() for choice in first[2].split("|")]
    again = re.match(rf"\(({char}{{2,}})(?![?*{{|]).*\)\{{[1-9]\d*,\}}\Z", pattern)
    return [again[1].lower()] if again and "|" not in re.sub(r"\([^()]*\)", "", pattern[1:].rsplit(")", 1)[0]) else []


def within_lines(pattern: str) -> bool:
    """Whether a pattern looks at one line only, so that a text has it if one of its lines has it.

    White space, classes of all characters but some, anchors, flags and unknown escapes may reach further.
    """
    return not re.search(r"\\[^bdw\W_]|[\^$]|\(\?(?![:!=])|[^\S ]", pattern)


def guarded(lowered: Column | Searched, pattern: str, found: Column) -> Column:
    """``found`` where the text has a literal that the pattern needs, else 0: a plain search is far cheaper than a pattern's."""
    literals = needed_literals(pattern)
    return F.when(reduce(or_, [has(lowered, x) for x in literals]), found).otherwise(0) if literals else found


def matches(text: Column, patterns: list[str], flags: str = "i", lowered: Column | Searched | None = None) -> Column:
    """Number of matches of all patterns; ``lowered`` is the lower-case text, if there is a column of it."""
    low = F.lower(text) if lowered is None else lowered
    return total([guarded(low, p, F.regexp_count(text, python_regex(p, flags))) for p in patterns])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, python_regex(r"^\s+|\s+\z", ""), F.lit(""))


def word_counts(text: Column) -> Column:
    """Number of words of each sentence."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_count(s, F.lit(r"(?U)\S+"))), lambda n: n > 0)


def words(text: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Non-blank pieces between sentence ends (one or more of .!? and a space or the end)."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda s: s != "")


def steps(count: Column, *levels: tuple[float, float]) -> Column:
    """The score of the first level that the count reaches, else 0; levels from the highest down."""
    out = F.lit(0.0)
    for least, score in reversed(levels):
        out = F.when(count >= least, score).otherwise(out)
    return out


def population_deviation(numbers: Column) -> Column:
    """Population standard deviation of an array of numbers; null for an empty one."""
    n = F.size(numbers)
    sums = lambda f: F.aggregate(numbers, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    mean = sums(lambda x: x) / F.nullif(n, F.lit(0))
    square = sums(lambda x: x * x) / F.nullif(n, F.lit(0)) - mean * mean
    return F.sqrt(F.greatest(square, F.lit(0.0)))


def split_lines(text: Column) -> Column:
    """Lines as Python's ``splitlines`` gives them: all its line ends count, and none is added by one at the end."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029])\z", ""), r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]")
