from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import parsers, udtf

PIECES = ["=== Human ===", "=== c ===", "===  SYSTEM  === ", "=== Other ===", "hello there", "", "  ", "<thinking>", "</thinking>", "a <THINKING> b </thinking>", "User: ask me ", "**Claude**: well", "A:yes", "h:", "x\ry", "Human: odd\r", "assistant: a b", "é=== W ==="]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(k, "\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14)))) for k in range(300)] + [(900, ""), (901, "no speaker\nat all"), (902, "=== H ==="), (903, "<thinking>\nnobody")]
    return spark.createDataFrame(rows, "k long, text string").repartition(3)


@pytest.mark.parametrize("thinking", [True, False])
def test_same_as_the_operator(spark, docs, thinking):
    lines = docs.select("k", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.lit("more").alias("extra"))
    got = udtf.registered(spark).sql(f"SELECT * FROM segments(TABLE({{lines}}) PARTITION BY k ORDER BY i, thinking => {str(thinking).lower()})", lines=lines)
    wanted = parsers.markdown_segments(docs, "k", thinking=thinking)
    assert got.columns == wanted.columns
    found, expected = (sorted(map(tuple, df.collect())) for df in (got, wanted))
    assert found == expected and len(found) > 300


def test_the_key_keeps_its_type(spark):
    lines = spark.createDataFrame([("d", 0, "=== H ==="), ("d", 1, "hi"), ("e", 0, None)], "name string, n int, line string")
    found = udtf.registered(spark).sql("SELECT * FROM segments(TABLE({lines}) PARTITION BY name ORDER BY n)", lines=lines)
    assert found.schema["name"].dataType.simpleString() == "string"
    assert [tuple(r) for r in found.where("name = 'd'").collect()] == [("d", 1, 1, "human", "text", "hi")]
    assert found.where("name = 'none'").count() == 0


def test_wrong_arguments(spark):
    session = udtf.registered(spark)
    with pytest.raises(Exception, match="segments take a table"):
        session.sql("SELECT * FROM segments('x')").collect()
    with pytest.raises(Exception, match="thinking is true or false"):
        session.sql("SELECT * FROM segments(TABLE(SELECT 1 AS a, 2 AS b, 'x' AS c) PARTITION BY a, thinking => 'no')").collect()
