"""Event-time windows and stateful signals over streams of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import half_up
from ..sources.commits import Store

LATE = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files, with event time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = LATE) -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return counted.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = LATE) -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return counted.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return counted.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class DecayedPeak(StatefulProcessor):
    """Per stream the decayed peak of a value: max of the new value and 0.85 of the last peak, rounded to 3."""

    DECAY = 0.85

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peak = handle.getValueState("peak", "peak double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Rows of one key and batch, in order of arrival of its parts; each part is sorted and handed on by itself."""
        last = self.peak.get()[0] if self.peak.exists() else 0.0
        for part in rows:
            found, out = part.sort_values("event_id"), []
            for value in found["value"].fillna(0.0):
                last = half_up(round(max(value, last * self.DECAY), 9))
                out.append(last)
            self.peak.update((last,))
            yield pd.DataFrame({"user_id": key[0], "event_id": found["event_id"], "peak": out})

    def close(self) -> None:
        pass


def decayed_peaks(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "value").groupBy("user_id").transformWithStateInPandas(DecayedPeak(), "user_id long, event_id long, peak double", "Append", "None")


def committed(stream: DataFrame, folder: str, mode: str) -> StreamingQuery:
    """Start a stream over all input there is; each micro-batch is a commit of the table ``rows`` under ``folder``.

    A batch that runs twice, also after the driver was restarted, is committed once; in complete mode the last batch
    stands for all. ``folder`` must be shared by all executors; a later run with the same one goes on where it stopped.
    """
    store = Store(stream.sparkSession, f"{folder}/out")

    def write(df: DataFrame, number: int) -> None:
        store.commit("stream", number, {"rows": df}, replace=mode == "complete")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over all input there is and return its output as a table."""
    place = f"{folder}/stream-{uuid.uuid4().hex}"
    committed(stream, place, mode).awaitTermination()
    return Store(stream.sparkSession, f"{place}/out").read("rows", stream.schema)
