"""Joins of two streams: logs with the sessions near them in time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(rows: pa.StructArray) -> tuple[np.ndarray, list]:
    """Times, ascending, and ids of a list of (at, id)."""
    at = rows.field("at").to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    return at[order], rows.field("id").take(pa.array(order)).to_pylist()


def least_near(logs: np.ndarray, early: tuple[np.ndarray, list], middle: Any, later: tuple[np.ndarray, list], micros: int) -> list:
    """The least session near each log (by time): of all in the middle, the last ones before and the first ones after."""
    ids = [*early[1], *later[1], *([] if middle is None else [middle])]
    names = sorted(set(ids))
    place = {name: i for i, name in enumerate(names)}
    ranks, none, split = np.array([place[i] for i in ids], np.int64), np.array([len(names)]), len(early[1])
    from_here = np.append(np.minimum.accumulate(ranks[:split][::-1])[::-1], none)
    up_to_here = np.append(none, np.minimum.accumulate(ranks[split : split + len(later[1])]))
    least = np.minimum(from_here[np.searchsorted(early[0], logs - micros, "right")], up_to_here[np.searchsorted(later[0], logs + micros, "left")])
    if middle is not None:
        least = np.minimum(least, place[middle])
    names.append(None)
    return [names[i] for i in least.tolist()]


def interval_match(logs: DataFrame, sessions: DataFrame, log: str, session: str, log_time: str, session_time: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Every log with the first session (by ``session``) whose time is under ``seconds`` away, null if there is none.

    Both streams go to overlapping windows of three times that width: a log to the one whose middle third has it, a
    session to all three that have it. A window is decided when the watermark, ``late`` behind the latest time of the
    slower stream, has passed it, and then leaves the state; what comes to it later, and rows without a time, are dropped.
    Near a log are the sessions of the middle third, the last ones of the third before and the first ones of the third
    after, so the least is read off running minima: the work grows with the rows, not with the pairs that are near.
    Logs equal in time and id count once.
    """
    micros, types = seconds * 1_000_000, (logs.schema[log].dataType, sessions.schema[session].dataType)
    left = logs.where(F.col(log_time).isNotNull()).withWatermark(log_time, late).select(F.col(log_time).alias("_t"), F.lit(True).alias("_is_log"), F.col(log).alias("_log"), F.lit(None).cast(types[1]).alias("_session"))
    right = sessions.where(F.col(session_time).isNotNull()).withWatermark(session_time, late).select(F.col(session_time).alias("_t"), F.lit(False).alias("_is_log"), F.lit(None).cast(types[0]).alias("_log"), F.col(session).alias("_session"))
    placed = left.union(right).withColumn("_w", F.window("_t", f"{3 * seconds} seconds", f"{seconds} seconds"))
    third = F.floor((F.unix_micros("_t") - F.unix_micros("_w.start")) / micros)
    kept = placed.withColumn("_third", third).where("CASE WHEN _is_log THEN _third = 1 ELSE _session IS NOT NULL END")
    listed = lambda n: F.collect_list(F.when(~F.col("_is_log") & (F.col("_third") == n), F.struct(F.unix_micros("_t").alias("at"), F.col("_session").alias("id"))))
    decided = kept.groupBy("_w").agg(
        F.collect_set(F.when(F.col("_is_log"), F.struct(F.unix_micros("_t").alias("at"), F.col("_log").alias("id")))).alias("logs"),
        listed(0).alias("early"), F.min(F.when(F.col("_third") == 1, F.col("_session"))).alias("middle"), listed(2).alias("later"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, early, later = (batch.column(n)[i].values for n in ("logs", "early", "later"))
                times = found.field("at").to_numpy(zero_copy_only=False)
                least = least_near(times, _sorted(early), batch.column("middle")[i].as_py(), _sorted(later), micros)
                yield pa.RecordBatch.from_arrays([found.field("id"), pa.array(least, batch.column("middle").type)], [log, session])

    schema = T.StructType([T.StructField(log, types[0]), T.StructField(session, types[1])])
    return decided.where(F.size("logs") > 0).select("logs", "early", "middle", "later").mapInArrow(run, schema)
