"""A table as a stream of files that arrive one batch after the other, rows out of order within a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event time of the row that ends a replay: it carries the watermark past all others.
END = "2200-01-01 00:00:00"


#: Rows that one file of a large arrival has, about.
ROWS = 250_000


def arrivals(rows: DataFrame, time: str, folder: str, files: int, step_seconds: int, delay: Column) -> int:
    """Write ``rows`` as the arrivals of a stream: a row comes with the arrival of its time, some ``delay`` later.

    Arrivals cover ``step_seconds`` from the first time on, the last one also all that follows, and are written one by
    one, as a file source takes them in that order. Each has the same number of files, which is returned: one, or more
    if all have many rows, so that they are written and read in parallel. A last file has one row of nulls at the time END.
    """
    first = rows.agg(F.min(time)).first()[0]
    at = F.floor((F.unix_micros(time) - F.unix_micros(F.lit(first))) / (step_seconds * 1_000_000)) + delay
    numbered = rows.withColumn("_file", F.least(F.greatest(at, F.lit(0)), F.lit(files - 1)).cast("int"))
    counts = {r["_file"]: r["count"] for r in numbered.groupBy("_file").count().collect()}
    each = max(1, min(min(counts.get(n, 0) for n in range(files)) // ROWS, rows.sparkSession.sparkContext.defaultParallelism))
    for number in range(files):
        numbered.where(F.col("_file") == number).drop("_file").repartition(each).write.mode("append").parquet(folder)
    end = [F.to_timestamp(F.lit(END)) if c == time else F.lit(None).cast(t) for c, t in rows.dtypes]
    closing = rows.sparkSession.range(1).select(*[e.alias(c) for e, c in zip(end, rows.columns, strict=True)])
    closing.coalesce(1).write.mode("append").parquet(folder)
    return each


def replayed(rows: DataFrame, folder: str, files: int = 1) -> DataFrame:
    """The stream of what ``arrivals`` has written, one arrival of so many files a batch; ``rows`` gives the columns."""
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
