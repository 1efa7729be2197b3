from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import guards, relate
from quillstream.plans import ledger
from quillstream.streaming import guards as guard_streams
from quillstream.streaming import joins, replay, windows


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, windows.ROCKSDB)
    yield
    spark.conf.unset(key)


START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def calls(spark, n=400, days=10, streams=5):
    rng = random.Random(6)
    rows = [(rng.randrange(streams), i, START + datetime.timedelta(seconds=rng.randrange(days * 86400)), rng.choice([0.001, 0.01, None, 0.03]), rng.choice("xyz"), rng.choice("pqr")) for i in range(n)]
    return spark.createDataFrame(rows, "s long, i long, ts timestamp, cost double, caller string, digest string")


def arguments():
    return ("s", "caller", "ts", "i", "cost", "digest", 0.02, 0.05, F.lit(3.0), F.lit(1 / 40000), 2, 90_000)


def shown(df):
    return {r["i"]: (r["s"], r["allowed"], r["errors"]) for r in df.collect()}


def test_guard_stream_equals_the_batch_over_shuffled_files(spark, tmp_path):
    rows = calls(spark)
    replay.arrivals(rows, "ts", str(tmp_path / "in"), 6, 2 * 86400, F.pmod("i", F.lit(3)))
    stream = guard_streams.guarded_stream(replay.replayed(rows, str(tmp_path / "in")), *arguments(), late="5 days")
    got, wanted = shown(windows.drained(stream, str(tmp_path), "append")), shown(guards.guarded(rows, *arguments()))
    assert got == wanted and len(got) == 400
    assert {e for _, _, errors in got.values() for e in errors.split(",")} >= {"", "hourly", "daily", "rate", "loop"}


def test_late_calls_are_dropped(spark, tmp_path):
    """A call behind the watermark is dropped; the others are decided as if it had never been."""
    rows = calls(spark, 60, 10, 1)
    late = rows.where("i = 0").withColumn("i", F.lit(1000).cast("long")).withColumn("ts", F.lit(START))
    replay.arrivals(rows, "ts", str(tmp_path / "in"), 3, 4 * 86400, F.lit(0))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = guard_streams.guarded_stream(replay.replayed(rows, str(tmp_path / "in")), *arguments(), late="1 day")
    assert shown(windows.drained(stream, str(tmp_path), "append")) == shown(guards.guarded(rows, *arguments()))


def test_state_stays_bounded(spark, tmp_path):
    """Of forty days of calls the state keeps what a day and the waiting time need, and in the end nothing."""
    rows = calls(spark, 1200, 40, 3)
    replay.arrivals(rows, "ts", str(tmp_path / "in"), 10, 4 * 86400, F.lit(0))
    stream = guard_streams.guarded_stream(replay.replayed(rows, str(tmp_path / "in")), *arguments(), late="1 hour")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 10 and max(sizes) < 300
    assert sizes[-1] <= 2 + max(0, 0)  # the closing row and its timer


def test_forgetting_changes_no_decision():
    rng = random.Random(3)
    plain, forgetful = (guards.Guard(0.02, 0.05, 2, 5000) for _ in range(2))
    now = 0.0
    for _ in range(3000):
        now += rng.expovariate(1 / 900)
        call = (now, rng.choice([0.001, 0.01, None]), rng.choice("xy"), rng.choice("pq"), 3.0, 1 / 4000)
        again = guards.Guard(0.02, 0.05, 2, 5000)
        again.load(*forgetful.dump())
        forgetful = again
        assert plain.decide(*call) == forgetful.decide(*call)
        forgetful.forget(now)
        assert len(forgetful.dump()[0]) <= 0.05 / 0.001 + 86400 / 900 * 3


def test_interval_join_of_streams(spark, tmp_path):
    rng = random.Random(8)
    at = lambda: START + datetime.timedelta(seconds=rng.randrange(6 * 86400))
    logs = spark.createDataFrame([(i, at()) for i in range(500)] + [(900, START), (901, START + datetime.timedelta(days=3))], "log long, t timestamp")
    sessions = spark.createDataFrame([(i, at()) for i in range(300)] + [(700, START + datetime.timedelta(seconds=600)), (-5, START + datetime.timedelta(days=3, seconds=599))], "s long, u timestamp")
    for df, time, name in ((logs, "t", "logs"), (sessions, "u", "sessions")):
        replay.arrivals(df, time, str(tmp_path / name), 4, 2 * 86400, F.pmod(F.col(df.columns[0]), F.lit(2)))
    streams = [replay.replayed(df, str(tmp_path / name)) for df, name in ((logs, "logs"), (sessions, "sessions"))]
    found = windows.drained(joins.interval_match(*streams, "log", "s", "t", "u", 600, late="5 days"), str(tmp_path), "append")
    got = {r["log"]: r["s"] for r in found.where("log IS NOT NULL").collect()}
    matched = {r["log"]: r["s"] for r in relate.interval_match(logs, sessions, [], "log", "s", "t", "u", 600).collect()}
    assert got == {r["log"]: matched.get(r["log"]) for r in logs.collect()}
    assert got[901] == -5 and None in got.values() and len(matched) > 50


def test_a_batch_of_calls_sets_few_timers(spark, tmp_path):
    """Timers and state follow the groups of streams, not the calls: at most one of a batch, one of the rest and one to clear."""
    rows = calls(spark)
    replay.arrivals(rows, "ts", str(tmp_path / "in"), 6, 2 * 86400, F.pmod("i", F.lit(3)))
    stream = guard_streams.guarded_stream(replay.replayed(rows, str(tmp_path / "in")), *arguments(), late="5 days")
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    timers = [o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"]]
    assert timers and max(timers) <= 3 * 6


def test_interval_join_keeps_rows_not_pairs(spark, tmp_path):
    """In a dense hour every log is near every session; the state has windows, each row at most three times, and no pairs."""
    rng = random.Random(9)
    at = lambda: START + datetime.timedelta(microseconds=rng.randrange(3600 * 10**6))
    logs = spark.createDataFrame([(i, at()) for i in range(600)] + [(None, START + datetime.timedelta(days=3))], "log long, t timestamp")
    sessions = spark.createDataFrame([(f"s{rng.randrange(10**6)}", at()) for _ in range(600)] + [(None, START + datetime.timedelta(days=3))], "s string, u timestamp")
    for df, time, name in ((logs, "t", "logs"), (sessions, "u", "sessions")):
        replay.arrivals(df, time, str(tmp_path / name), 2, 86400, F.lit(0))
    streams = [replay.replayed(df, str(tmp_path / name)) for df, name in ((logs, "logs"), (sessions, "sessions"))]
    query = joins.interval_match(*streams, "log", "s", "t", "u", 1800, late="1 hour").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
    query = query.format("memory").queryName("dense").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress) < 20
    matched = {r["log"]: r["s"] for r in relate.interval_match(logs, sessions, [], "log", "s", "t", "u", 1800).collect() if r["log"] is not None}
    got = {r["log"]: r["s"] for r in spark.table("dense").where("log IS NOT NULL").collect()}
    assert got == {i: matched.get(i) for i in range(600)} and len(set(got.values())) > 1
