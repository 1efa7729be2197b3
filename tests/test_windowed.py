from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.functions.text import within_lines
from quillstream.operators import chunking, feels, saliency, windowed
from quillstream.plans import salience
from tests.compare import plain

VOICES = [
    ("Okay.", "So that is it. *one"), ("two* still", "ΟΔΟΣ maybe! I want"), ("", "that's"), (None, "perhaps"), ("kind?", ""), ("I WANT this?", "yes\u2028and . so"),
    ("what is it", "This is new! It seems unclear ... ok"), ("actually,", "wait\nI want\nthat's mine?"), ("lands here\ndifferent", "lands different. Odd"),
]


@pytest.mark.parametrize("pattern, local", [(r"\bi want\b(?!.*\?)", True), (r"\bself.as.filter\b", True), (r"so\.?\s*if", False), (r"\*[^*]+\*", False), ("a$", False), ("(?s)a.b", False), ("a\nb", False), (r"a\Wb", False), (r"\d+\.", True)])
def test_patterns_within_lines(pattern, local):
    assert within_lines(pattern) == local


def test_windows_score_as_their_texts_do(spark):
    rows = [(conv, i, *v) for conv in (1, 2) for i, v in enumerate(VOICES if conv == 1 else VOICES[::-1])]
    pairs = spark.createDataFrame(rows, "conv_id long, pair int, voice_a string, voice_b string").repartition(2)
    families = [*saliency.heuristics("alex"), ("reaching", 1.0, [r"odd\n\n===", "a\n\n===", r"(?s)two.*kind", "voice [ab]"])]
    dressed = lambda df: df.withColumn("tags", F.array(F.when(F.col("chunk_index") % 2 == 0, feels.META).otherwise(feels.CLOSED)))
    overlaps = {1: 0, 2: 1, 3: 1, 4: 2}
    names = ["conv_id", "pair_count", "chunk_index", "feels_score", "salience", *[f"h_{k}" for k, _, _ in families]]
    texts = saliency.with_salience(feels.with_feels(dressed(chunking.chunk_windows(pairs, overlaps))), families=families)
    found = windowed.with_both_scores(pairs, overlaps, families, dressed)
    got, wanted = ([tuple(map(plain, r[:-1])) + (sorted(r[-1].items()),) for r in df.select(*names, "feels_components").orderBy(*names[:3]).collect()] for df in (found, texts))
    assert got == wanted and len(got) == 2 * (9 + 8 + 4 + 3)
    assert any(r[names.index("h_reaching")] for r in got)


def test_texts_are_searched_before_they_are_windowed(spark, sf):
    """Nor does a filter on the score bring the search back."""
    plan = salience.both_scores(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Generate posexplode") < plan.index("ArrowEvalPython")
    assert "ArrowEvalPython" not in salience.effective(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
