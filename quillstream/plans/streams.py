"""Queries over streams that replay the events as late files: guards and the join of dialogs with sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch
from ..streaming import guards, joins, replay, windows
from . import ledger

#: Files that a replay arrives in, seconds of events that each covers, and how many files later rows may come.
FILES, STEP, DELAY = 6, 5 * 86400, 3
LATE = "16 days"


def with_settings(spark: SparkSession, settings: dict[str, str], run: Callable[[], DataFrame]) -> DataFrame:
    """Run with some settings of the session, and set back what was before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with the state store that stateful processors need."""
    return with_settings(spark, {"spark.sql.streaming.stateStore.providerClass": windows.ROCKSDB}, run)


def with_few_stores(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with two state stores a core at most: every batch opens and commits each, however few of its keys changed."""
    key = "spark.sql.shuffle.partitions"
    stores = min(int(spark.conf.get(key)), 2 * spark.sparkContext.defaultParallelism)
    return with_rocksdb(spark, lambda: with_settings(spark, {key: str(stores)}, run))


def arriving(rows: DataFrame, time: str, number: str) -> DataFrame:
    """The rows as a stream of late files."""
    folder = scratch(rows.sparkSession, "replay")
    files = replay.arrivals(rows, time, folder, FILES, STEP, F.pmod(F.xxhash64(number), F.lit(DELAY)))
    return replay.replayed(rows, folder, files)


def q_stream_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call held against budget, rate limit and repeats, decided as the watermark passes it."""
    calls = ledger.ledger(spark, sf_dir).select("user_id", "event_id", "ts", "cost", F.lit("any").alias("caller"), F.col("event_type").alias("digest"))
    stream = guards.guarded_stream(arriving(calls, "ts", "event_id"), *ledger.GUARD_COLUMNS, ledger.HOURLY, 0.05, F.lit(3.0), F.lit(1 / 86400), 2, 200000, LATE)
    return with_rocksdb(spark, lambda: windows.drained(stream, scratch(spark, "stream"), "append"))


def q_stream_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogs with the first session near them, and those without any, from two streams of late files."""
    logs, sessions = ledger.dialogs(spark, sf_dir)
    streams = arriving(logs, "ts", "event_id"), arriving(sessions, "session_ts", "session_id")
    found = joins.interval_match(*streams, "event_id", "session_id", "ts", "session_ts", 600, LATE)
    return with_few_stores(spark, lambda: windows.drained(found, scratch(spark, "stream"), "append")).where("event_id IS NOT NULL")


def oracles() -> dict[str, str]:
    again = ledger.oracles()
    return {
        "stream_guarded": again["guarded_calls"],
        "stream_dialogs": f"SELECT e.event_id, session_id FROM (SELECT event_id FROM events WHERE event_type = 'error') e LEFT JOIN ({again['dialog_match']}) m USING (event_id)",
    }
