"""Scans over streams of any length: segments of a stream in parallel, what each amounts to, what is carried on.

A stream's rows are dealt out by ranges of stream and order, so a long stream lies in many segments, each in a task of
its own. A window or fold runs inside every segment; a summary of each segment (a sum, a run, a peak, a function from state to
state) is an ordinary aggregate. Summaries of a stream, at most one a segment, are put together in order, and what
stands before a segment is joined to its rows. Rows of one stream with equal order values are in no defined order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..sources.tables import stored

SEGMENT = "_segment"


def segmented(df: DataFrame, stream: str | list[str], order: list[str | Column], segments: int | None = None) -> DataFrame:
    """The rows with the number of their segment; segments of a stream (one or more columns, or none) are numbered in order.

    The rows are stored twice: before ranges are sampled from them, and with the segments, which later readers must
    agree on. Callers select the columns that they need first.
    """
    count = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df).repartitionByRange(count, *([stream] if isinstance(stream, str) else stream), *order)
    return stored(dealt.withColumn(SEGMENT, F.spark_partition_id().cast("long")))


def inside(stream: list[str], order: list[str | Column]) -> WindowSpec:
    """The rows of a stream in one segment, in order."""
    return Window.partitionBy(SEGMENT, *stream).orderBy(*order)


def carried(rows: DataFrame, stream: list[str], summary: dict[str, Column], carry: Callable[[DataFrame, WindowSpec], dict[str, Column]]) -> DataFrame:
    """Join to each row what its stream amounts to before its segment.

    ``summary`` names aggregates of a segment; ``carry`` gives columns over the summaries, given the window of those
    before. Its columns may build on each other in order; those whose names begin with ``_`` are joined to the rows.
    """
    parts = rows.groupBy(SEGMENT, *stream).agg(*[c.alias(n) for n, c in summary.items()])
    before = Window.partitionBy(*(stream or [F.lit(0)])).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    made = carry(parts, before)
    for name, column in made.items():
        parts = parts.withColumn(name, column)
    keys = [SEGMENT, *stream]
    found = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[n for n in made if n.startswith("_")])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(found, same).drop(*[f"_k{i}" for i in range(len(keys))])


def running_sums(rows: DataFrame, stream: list[str], order: list[str | Column], sums: dict[str, Column], itself: bool = True) -> DataFrame:
    """Add sums over all rows of the stream up to each row (0 before the first), with or without the row itself."""
    w = inside(stream, order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    own = rows.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()])
    summary = {f"s_{n}": F.sum(c) for n, c in sums.items()}
    found = carried(own, stream, summary, lambda _, before: {f"_c_{n}": F.coalesce(F.sum(f"s_{n}").over(before), F.lit(0)) for n in sums})
    return found.select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])


def run_length(rows: DataFrame, stream: list[str], order: list[str | Column], flag: str, name: str) -> DataFrame:
    """Number of rows with the flag set in a row up to each row (0 where it is not set)."""
    w = inside(stream, order)
    placed = rows.withColumn("_r", F.row_number().over(w))
    unset = F.when(~F.col(flag), F.col("_r"))
    placed = placed.withColumn("_z", F.max(unset).over(w))
    found = carried(
        placed, stream, {"n": F.count("*"), "z": F.max(unset)},
        lambda _, before: {"_start": F.coalesce(F.sum("n").over(before), F.lit(0)), "_last": F.max(F.col("_start") + F.col("z")).over(before)},
    )
    length = F.col("_start") + F.col("_r") - F.coalesce(F.col("_start") + F.col("_z"), F.col("_last"), F.lit(0))
    return found.select(*rows.columns, length.alias(name))


def last_before(rows: DataFrame, stream: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Add the last value that is not null of the rows before each row."""
    w = inside(stream, order)
    own = rows.withColumn("_i", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_r", F.row_number().over(w))
    found = carried(
        own, stream, {"l": F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_r")))},
        lambda _, before: {"_c": F.last("l", ignorenulls=True).over(before)},
    )
    return found.select(*rows.columns, F.coalesce("_i", "_c").alias(name))


def with_history(rows: DataFrame, stream: list[str], order: list[str], columns: list[str], size: int) -> DataFrame:
    """The rows, and in each segment copies of the ``size`` rows of its stream before it, marked ``_copy``.

    For windows that look back a bounded number of rows. Copies have the stream, order and ``columns`` only.
    """
    w = inside(stream, order)
    tails = rows.withColumn("_t", F.lead(F.lit(1), size).over(w)).where("_t IS NULL")
    parts = tails.groupBy(SEGMENT, *stream).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("tail"))
    before = Window.partitionBy(*stream).orderBy(SEGMENT).rowsBetween(-size, -1)
    past = parts.withColumn("_p", F.flatten(F.collect_list("tail").over(before)))
    kept = F.slice("_p", F.greatest(F.lit(1), F.size("_p") - size + 1), size)
    copies = past.select(SEGMENT, *stream, F.explode(kept).alias("_h")).select(SEGMENT, *stream, "_h.*", F.lit(True).alias("_copy"))
    return rows.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)


def _each(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def composed(
    rows: DataFrame, stream: str, order: str, values: list[str], start: Any, step: Callable[[Any, tuple], tuple[Any, tuple]],
    nothing: Any, extend: Callable[[Any, tuple], Any], enter: Callable[[Any, Any], Any], schema: str,
) -> DataFrame:
    """Rows (stream, order, result ...) of a fold over streams whose steps compose to functions that can be written down.

    ``step(state, values)`` gives the next state and the row's result. A segment's steps together are one function from
    state to state, in a form that begins as ``nothing``, grows by ``extend(form, values)`` and is applied by
    ``enter(state, form)``. Each segment is folded twice: to its form, and, once the state before it is known from the
    forms before, to its results. States and forms are of numbers, lists and None.
    """
    kinds = dict(rows.dtypes)
    keys = f"`{SEGMENT}` long, `{stream}` {kinds[stream]}"
    part_kinds, full = f"{keys}, state string", f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, {schema}"
    part_schema, out_schema = (to_arrow_schema(_parse_datatype_string(k)) for k in (part_kinds, full))
    count = rows.rdd.getNumPartitions()
    needed = list(dict.fromkeys([SEGMENT, stream, order, *values]))
    lean = rows.select(*needed)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            last, form = None, None
            for segment, key, *row in _each(batches, [SEGMENT, stream, *values]):
                if last != (segment, key):
                    if last is not None:
                        yield (*last, json.dumps(form))
                    last, form = (segment, key), nothing
                form = extend(form, tuple(row))
            if last is not None:
                yield (*last, json.dumps(form))

        return _batches(made(), part_schema)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            begun, last, state = False, None, None
            for segment, key, form in _each(batches, [SEGMENT, stream, "state"]):
                if not begun or key != last:
                    begun, last, state = True, key, start
                yield segment, key, json.dumps(state)
                state = enter(state, json.loads(form))

        return _batches(made(), part_schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In every segment of a stream the state before it comes first."""

        def made() -> Iterator[tuple]:
            state = None
            for given, key, mark, *row in _each(batches, ["state", stream, order, *values]):
                if given is not None:
                    state = json.loads(given)
                else:
                    state, result = step(state, tuple(row))
                    yield key, mark, *result

        return _batches(made(), out_schema)

    dealt = lean.repartition(count, SEGMENT, stream)
    parts = dealt.sortWithinPartitions(SEGMENT, stream, order).mapInArrow(forms, part_kinds)
    before = parts.repartition(F.col(stream)).sortWithinPartitions(stream, SEGMENT).mapInArrow(states, part_kinds)
    both = lean.withColumn("state", F.lit(None).cast("string")).unionByName(before, allowMissingColumns=True)
    return both.repartition(count, SEGMENT, stream).sortWithinPartitions(SEGMENT, stream, F.col("state").isNull(), order).mapInArrow(results, full)
