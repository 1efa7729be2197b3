from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, score double, size int, path string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdeéghilmnoprstu", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, long, repeated and tied rows, near copies and shared passages."""
    rng = random.Random(5)
    base, passage = prose(rng, 150), prose(rng, 90)
    words = base.split()
    texts = [
        (1, base), (1, base), (2, base), (3, None), (4, ""), (5, "  \n "), (6, "one two"), (7, "one two"), (None, "three four five six"),
        (8, " ".join([*words[:70], "changed", *words[71:]])), (9, " ".join([*words[:20], "other", *words[21:]])), (10, prose(rng, 60) + " " + passage),
        (11, passage + " " + prose(rng, 40)), (12, prose(rng, 5000)), (13, "x" * 5000), (14, "é" * 900), (15, None), (16, prose(rng, 200)),
        (17, passage.upper()), (18, "\x00 weird \x1f ctrl\n" * 40), (19, prose(rng, 30) + "\n" + prose(rng, 30)),
    ]
    return texts


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The rows with all columns of documents and more, whose names clash with internal ones."""
    rows = [(i, t, "xx", "s", len(t or ""), "k", 7, 0.5, 3, "p") for i, t in edge_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.rand(1))


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
