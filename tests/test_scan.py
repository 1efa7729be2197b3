from __future__ import annotations

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.operators import asof, order, relate, scan, temporal
from quillstream.operators.folds import half_up

LABELS = ["calm", "bored", None, "calm", "calm"]


@pytest.fixture(scope="module")
def rows():
    """One stream with most rows, small ones, one of a single row, and one whose name is null; values may be null."""
    rng = random.Random(4)
    names = ["hot"] * 700 + ["a"] * 40 + ["b"] * 7 + ["one"] + [None] * 90
    rng.shuffle(names)
    return [(n, i, rng.choice([0.0, 0.05, 0.3, 0.5, 2.0, None]), rng.random() < 0.6, rng.choice(LABELS)) for i, n in enumerate(names)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "s string, i long, x double, flag boolean, label string").repartition(5, F.rand(2))


def streams(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    return out


@pytest.mark.parametrize("segments", [3, 40])
class TestAgainstLoops:
    def test_segments_follow_the_order(self, df, rows, segments):
        found = scan.segmented(df, "s", ["i"], segments).collect()
        assert len(found) == len(rows)
        for name, mine in streams(rows).items():
            place = {r["i"]: r[scan.SEGMENT] for r in found if r["s"] == name}
            numbers = [place[r[1]] for r in mine]
            assert numbers == sorted(numbers)
            assert segments < 3 or name != "hot" or len(set(numbers)) > 1

    def test_sums(self, df, rows, segments):
        seg = scan.segmented(df, "s", ["i"], segments)
        for itself in (True, False):
            got = {r["i"]: (r["n"], r["t"]) for r in scan.running_sums(seg, ["s"], ["i"], {"n": F.lit(1), "t": F.col("x")}, itself).collect()}
            for mine in streams(rows).values():
                n, t = 0, 0.0
                for r in mine:
                    before = (n, t)
                    n, t = n + 1, t + (r[2] or 0.0)
                    assert got[r[1]] == pytest.approx((n, t) if itself else before)

    def test_run_length(self, df, rows, segments):
        got = {r["i"]: r["k"] for r in temporal.run_length(df, "s", "i", "flag", "k", segments).collect()}
        for mine in streams(rows).values():
            k = 0
            for r in mine:
                k = k + 1 if r[3] else 0
                assert got[r[1]] == k

    def test_last_observed(self, df, rows, segments):
        got = {r["i"]: r["seen"] for r in temporal.with_last_observed(df, "s", "i", "label", "seen", segments).collect()}
        for mine in streams(rows).values():
            seen = None
            for r in mine:
                assert got[r[1]] == seen
                seen = r[4] if r[4] is not None else seen

    def test_feeling_runs(self, df, rows, segments):
        found = temporal.feeling_runs(df, "s", "i", "label", segments)
        assert found.columns == [*df.columns, "in_state", "previous"]
        got = {r["i"]: (r["in_state"], r["previous"]) for r in found.collect()}
        assert len(got) == len(rows)
        for mine in streams(rows).values():
            k, labels = 0, []
            for r in mine:
                k = k + 1 if labels and r[4] is not None and labels[-1] == r[4] else 1
                labels.append(r[4])
                assert got[r[1]] == (k, ",".join(x for x in labels[-10:] if x is not None))

    def test_elevation(self, df, rows, segments):
        found = temporal.elevation(df, "s", "i", "x", segments=segments)
        assert found.columns == [*df.columns, "elevated", "streak"]
        got = {r["i"]: (r["elevated"], r["streak"]) for r in found.collect()}
        for mine in streams(rows).values():
            past, streak = [], 0
            for r in mine:
                known = [x for x in past[-50:] if x is not None]
                middle = statistics.median(known) if known else None
                up = len(known) >= 3 and r[2] is not None and (r[2] > 0.1 if middle == 0 else r[2] > 1.5 * middle)
                streak = streak + 1 if up else 0
                assert got[r[1]] == (up, streak)
                past.append(r[2])

    def test_decayed_peaks(self, df, rows, segments):
        got = {r["i"]: r["d_x"] for r in temporal.decayed_peaks(df, "s", "i", {"x": 0.5}, segments).collect()}
        closed = {r["i"]: r["peak"] for r in temporal.decayed_peaks_closed(df, "s", "i", "x", segments=segments).collect()}
        for mine in streams(rows).values():
            rounded, peak = 0.5, 0.0
            for r in mine:
                rounded, peak = half_up(max(r[2] or 0.0, rounded * 0.85)), max(r[2] or 0.0, peak * 0.85)
                assert got[r[1]] == rounded
                assert closed[r[1]] == pytest.approx(peak, rel=1e-9, abs=1e-12)

    def test_drives(self, spark, rows, segments):
        rng = random.Random(1)
        pulses = [(r[0], r[1], *(rng.random() < p for p in (0.3, 0.5, 0.2, 0.3, 0.5))) for r in rows]
        df = spark.createDataFrame(pulses, "s string, i long, code_changed boolean, notes_written boolean, publishable boolean, research boolean, reflective boolean")
        got = {r["i"]: (r["building"], r["publishing"], r["experimenting"]) for r in temporal.drives(df, "s", "i", segments).collect()}
        for mine in streams(pulses).values():
            levels = (0.0, 0.0, 0.0)
            for _, i, code, notes, publishable, research, reflective in mine:
                moves = (-0.4 if code else 0.15, -0.35 if publishable else 0.05 if notes else 0.1, -0.3 if research else -0.12 if code else 0.08 if reflective else -0.03)
                levels = tuple(half_up(max(0.0, min(1.0, x + m))) for x, m in zip(levels, moves))
                assert got[i] == levels

    def test_baselines(self, spark, rows, segments):
        rng = random.Random(2)
        data = [(r[0], r[1], rng.choice(["philosophical", "companion", "unheard"]), rng.random(), float(rng.randrange(4))) for r in rows]
        df = spark.createDataFrame(data, "s string, i long, kind string, hedging_ratio double, self_correction double")
        got = {r["i"]: (r["z_hedging_ratio"], r["z_self_correction"]) for r in temporal.baseline_scores(df, "s", "i", "kind", ["hedging_ratio", "self_correction"], segments).collect()}
        state = {}
        for s, i, kind, *values in sorted(data, key=lambda r: r[1]):
            for k, (name, x) in enumerate(zip(["hedging_ratio", "self_correction"], values, strict=True)):
                m, d = temporal.SEEDS.get(kind, temporal.SEEDS["exploratory"])[temporal.SIGNALS.index(name)]
                n, mean, m2 = state.get((s, kind, name), (5, m, 5 * d * d))
                sd = (m2 / n) ** 0.5
                assert got[i][k] == pytest.approx((x - mean) / sd, abs=0.00501)
                n, gap = n + 1, x - mean
                mean += gap / n
                state[s, kind, name] = n, mean, m2 + gap * (x - mean)

    def test_packing(self, df, rows, segments):
        sized = df.withColumn("tokens", F.pmod("i", F.lit(37)))
        got = {r["i"]: r["used"] for r in relate.packed(sized, "s", [F.col("x").desc_nulls_last(), F.col("i")], "tokens", 2000, 500, segments).collect()}
        wanted = {}
        for mine in streams(rows).values():
            used = 0
            for r in sorted(mine, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1])):
                used += r[1] % 37
                if used < 1500:
                    wanted[r[1]] = used
        assert got == wanted


def test_a_hot_stream_is_dealt_to_all_tasks(spark):
    """One stream holds all rows: its segments are of like size, and windows run in as many tasks."""
    df = spark.range(200_000).select(F.lit("hot").alias("s"), F.col("id").alias("i"), (F.pmod("id", F.lit(11)) < 9).alias("flag"))
    sizes = [r["count"] for r in scan.segmented(df, "s", ["i"], 16).groupBy(scan.SEGMENT).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 200_000 / 16
    runs = temporal.run_length(df, "s", "i", "flag", "k", 16)
    assert runs.where("k <> CASE WHEN pmod(i, 11) < 9 THEN pmod(i, 11) + 1 ELSE 0 END").count() == 0


def test_empty(spark, df):
    nothing = df.limit(0)
    assert temporal.run_length(nothing, "s", "i", "flag", "k").count() == 0
    assert temporal.elevation(nothing, "s", "i", "x").count() == 0
    assert temporal.feeling_runs(nothing, "s", "i", "label").count() == 0
    assert temporal.decayed_peaks(nothing, "s", "i", {"x": 0.0}).count() == 0
    assert temporal.decayed_peaks_closed(nothing, "s", "i", "x").count() == 0


@pytest.mark.parametrize("segments", [1, 30])
def test_as_of_join(spark, segments):
    """A hot key, equal times, ties, missing keys and times; every row stays once."""
    rng = random.Random(7)
    keys = ["hot"] * 8 + ["a", "b", None, "none"]
    rows = [(rng.choice(keys), i, None if i % 40 == 7 else rng.randrange(3000)) for i in range(500)]
    facts = [(rng.choice(keys[:-1]), None if i % 50 == 9 else rng.randrange(3000), i % 7, f"v{i}") for i in range(300)] + [("a", 5, 100, None)]
    at = lambda c: F.timestamp_seconds(c)
    left = spark.createDataFrame(rows, "k string, i int, s int").withColumn("t", at("s")).withColumn("_t", F.lit("clash"))
    right = spark.createDataFrame(facts, "k string, s int, n int, v string").withColumn("u", at("s"))
    found = asof.latest_before(left, right, "k", "t", "u", ["v"], 600, "n", segments)
    assert found.columns == [*left.columns, "v"]
    got = {r["i"]: r["v"] for r in found.collect()}
    assert len(got) == found.count() == 500
    for k, i, s in rows:
        past = [f for f in facts if f[0] == k and f[1] is not None and s is not None and f[1] <= s]
        last = [f for f in past if f[:2] == max(past, key=lambda f: f[1])[:2]]
        best = {f[3] for f in last if f[2] == max(x[2] for x in last) and s - f[1] < 600} or {None}
        assert got[i] in best
    assert asof.latest_before(left, right.limit(0), "k", "t", "u", ["v"]).where("v IS NOT NULL").count() == 0
    assert asof.latest_before(left.limit(0), right, "k", "t", "u", ["v"]).count() == 0


def test_a_value_of_many_rows_is_ranked_in_many_tasks(spark):
    """A third of the rows share one value; its ranks follow the ties, and ranges stay even."""
    df = spark.range(60_000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") % 1000).cast("double").alias("v"), F.col("id").alias("i"))
    found = order.ranked(df, ["g"], F.col("v"), [F.col("i")])
    assert found.where("v = 0").groupBy("g").agg((F.max("rank") == F.count("*")).alias("ok")).where("NOT ok").count() == 0
    by_rank = [r["i"] for r in found.where("g = 3 AND v = 0").orderBy("rank").collect()]
    assert by_rank == sorted(by_rank) and len(by_rank) > 2500
    keyed = df.withColumn("_k", F.col("v"))
    sizes = [r["count"] for r in scan.segmented(keyed, ["g"], ["_k", "i"], 12).groupBy(scan.SEGMENT).count().collect()]
    assert max(sizes) < 2 * 60_000 / 12
