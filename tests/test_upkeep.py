from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstream import Job, Registry, formatted, heuristic
from quillstream.functions.text import split_lines
from quillstream.operators import companions, feels, guards, injection, order, pairs, temporal, upkeep
from quillstream.plans import memory
from quillstream.plans import upkeep as plans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lines_as_python_splits_them(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "x\n\ny\n\n", "\r\n\r\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", split_lines(F.col("t")).alias("l")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        assert row["l"] == (text.splitlines() or [""])


@pytest.mark.parametrize("sizes, overlaps", [("0,1", ""), ("1,2", "2"), ("1,2", "2:2"), ("3", "3:-1"), ("", "")])
def test_overlaps_that_make_no_sense(sizes, overlaps):
    with pytest.raises(ValueError):
        pairs.parsed_overlaps(sizes, overlaps)


def test_overlaps():
    assert pairs.parsed_overlaps("1, 2,5,", "2:1, 5:2,") == {1: 0, 2: 1, 5: 2}


def test_blocks(spark):
    text = "x\n=== W ===\nhi\n\n=== Other ===\ngone\n=== Assistant ===\n\nyes\nno\n\n\n=== C ===\n=== Human ==="
    rows = pairs.role_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string"), "k").orderBy("block").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("Human", "hi"), ("Assistant", "\nyes\nno")]


def test_ranks_equal_a_sort(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, 0.0, 1.5, rng.random()]), i) for g in ("a", "b", None) for i in range(400)] + [("c", 1.0, 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(3)
    found = order.ranked(df, ["g"], -F.col("v"), [F.col("i")]).collect()
    for g in ("a", "b", None, "c"):
        wanted = sorted((-v, i) for x, v, i in rows if x == g and v is not None)
        assert [(-r["v"], r["i"]) for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["rank"])] == wanted
    few = order.ranked(df, ["g"], F.col("v"), [F.col("i")], lambda rank, n: rank <= n / 10).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in few} == {"a": 40, "b": 40, None: 40}


def test_values_and_nearest_rank_equal_a_sort(spark):
    rng = random.Random(5)
    values = [rng.choice([0.0, 2.0, rng.gauss(0, 3)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    found = order.values_at(df, "v", {"low": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2), "top": lambda n: n}).first()
    assert tuple(found) == (min(values), sorted(values)[1499], max(values))
    for p in (0.0, 0.1, 0.7, 1.0):
        got = feels.nearest_rank(df.withColumn("g", F.lit(1)), ["g"], "v", p, "x").first()["x"]
        assert got == sorted(values)[round((len(values) - 1) * p)]


def test_decayed_peaks_of_a_long_stream(spark):
    df = spark.range(10_000).select(F.lit(1).alias("s"), "id", F.when(F.col("id") % 50 == 0, F.col("id") / 1000).otherwise(0.0).alias("v"))
    peak = 0.0
    for i, row in enumerate(temporal.decayed_peaks_closed(df, "s", "id", "v").orderBy("id").collect()):
        peak = max(row["v"], 0.85 * peak)
        assert row["peak"] == pytest.approx(peak, rel=1e-9), i


def test_guard_names_all_that_fail(spark):
    rows = [(1, 0.0, 1.0, "p"), (2, 1.0, 1.0, "p"), (3, 2.0, 9.0, "p"), (4, 3.0, 0.1, "q"), (5, 100.0, 0.1, "q"), (6, 4000.0, 1.0, "p")]
    df = spark.createDataFrame(rows, "i int, t double, c double, d string").select("i", "c", "d", F.timestamp_seconds("t").alias("at"), F.lit("s").alias("s"), F.lit("me").alias("who"))
    found = guards.guarded(df, "s", "who", "at", "i", "c", "d", 3.0, 20.0, F.lit(2.0), F.lit(0.1), most=2, seconds=300)
    assert {r["i"]: r["errors"] for r in found.collect()} == {1: "", 2: "", 3: "hourly,rate,loop", 4: "rate", 5: "", 6: ""}


def test_limits_fall_back(spark):
    config = {"a": {"per_hour": 60, "burst_allowance": 5}, "general": {"per_minute": 2}}
    full, rate = guards.limit_of(F.col("s"), config)
    rows = spark.createDataFrame([("a",), ("b",)], "s string").select("s", full.alias("f"), rate.alias("r")).collect()
    assert {r["s"]: (r["f"], round(r["r"], 6)) for r in rows} == {"a": (65.0, round(1 / 60, 6)), "b": (2.0, round(2 / 60, 6))}
    full, rate = guards.limit_of(F.lit("x"), {})
    assert one(spark, full) == 10.0


def test_sections_and_dates(spark):
    text = F.lit("# T\n## Sitting [x]\n**New (2024-01-04)** a\n(2023-02-30) Updated 2023-05-06\n## Next\n(2020-01-01)")
    assert [str(d) for d in one(spark, upkeep.section_dates(text, "Sitting [x]"))] == ["2023-05-06", "2024-01-04", "2024-01-04"]
    assert one(spark, upkeep.section_dates(text, "Other")) == []
    assert one(spark, upkeep.days_since(F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))) == 999


def test_cooldown_grows_and_ends(spark):
    assert [one(spark, companions.cooldown(F.lit(n))) for n in (0, 1, 2, 3, 4, 6, 40)] == [0, 0, 3, 6, 12, 48, 48]
    rows = spark.createDataFrame([("x", i, f) for i, f in enumerate([True, True, None, None, None, False, True])], "s string, i int, f boolean")
    found = [r["available"] for r in companions.availability(rows, "s", "i", "f").orderBy("i").collect()]
    assert found == [True, True, False, False, True, True, True]


def test_texts_of_a_run(spark):
    assert one(spark, injection.self_empathy(F.lit("content"), F.lit(2))) is None
    assert "RT lens" in one(spark, injection.self_empathy(F.lit("bored"), F.lit(2)))
    quiet = injection.prediction_error(F.lit("a"), F.lit("a"), {"m": (F.lit(0.5), F.lit(0.2)), "n": (F.lit(1.0), F.lit(None).cast("double"))})
    assert one(spark, quiet) is None
    loud = one(spark, injection.prediction_error(F.lit("a"), F.lit("b"), {"m": (F.lit(0.5), F.lit(-2.0)), "n": (F.lit(1.0), F.lit(0.1))}))
    assert loud.split("\n") == ["Interoceptive signal (predicted: a, observed: b):", "- m: 0.5 (-2.0 std vs b baseline)", "- n: 1.0 (within expected)"]
    assert one(spark, injection.shortened_path(F.lit("/r/a/b.md"), "/r")) == "a/b.md" and one(spark, injection.shortened_path(F.lit("/q/b.md"), "/r")) == "b.md"


def test_registry_and_names(spark):
    registry = Registry().add(Job("a", lambda s: s.range(2), triggers=("new",))).add(Job("b", lambda s: s.table("missing"), priority=1))
    assert registry.names() == ["b", "a"] and registry.names("new") == ["a"]
    assert registry.run(spark, "a").count() == 2
    registry.run(spark, "b", dry_run=True)
    assert [(r["job"], r["status"]) for r in registry.records(spark).collect()] == [("a", "completed"), ("b", "failed")]
    with pytest.raises(KeyError):
        heuristic("unheard")
    best = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "g int, rank int, t string")
    assert formatted(best, "g", lambda s: F.array_join(F.transform(s, lambda x: x["t"]), "")).first()["report"] == "ab"


def test_context_and_lines_take_in_all_notes(spark, sf):
    """Every note of a source stands in its texts, also beyond what fits into one context."""
    found = memory.files(spark, sf).orderBy("source", "doc_id").collect()
    lines, bodies = {}, {}
    for r in found:
        lines.setdefault(r["source"], []).append(f"- **{r['path']}** ({r['date'] or 'unknown'}, {r['lines']} lines)\n  First line: {r['first_line'][:80]}...")
        age = f"({r['doc_id'] % 3} days old)" if r["doc_id"] % 3 else "(today)"
        bodies.setdefault(r["source"], []).append(f"### {r['path']} {age}\n\n{r['first_line']}")
    wanted = {s: hashlib.md5("\n".join(v).encode()).hexdigest() for s, v in lines.items()}
    assert {r["source"]: r["digest"] for r in plans.q_note_lines(spark, sf).collect()} == wanted
    least = {s: sum(len(b) for b in v) for s, v in bodies.items()}
    got = {r["source"]: r["chars"] for r in plans.q_context_assembly(spark, sf).collect()}
    assert got.keys() == least.keys() and all(got[s] > n for s, n in least.items())


def test_digests_of_pieces(spark):
    rows = [(None, 1, "a", ", "), ("x", 2, "ö", ", "), ("x", 1, "b", "-"), ("x", 3, None, ", "), ("y", 1, None, ", ")]
    df = spark.createDataFrame(rows, "g string, k int, t string, b string").repartition(3)
    got = {r["g"]: (r["digest"], r["chars"]) for r in upkeep.digests(df, "g", ["k"], "t", "b").collect()}
    assert got == {None: (hashlib.md5(b"a").hexdigest(), 1), "x": (hashlib.md5("b, ö".encode()).hexdigest(), 4)}
