"""Folds over each key's rows in order, for feedback that no window expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def half_up(value: float, digits: int = 3) -> float:
    """Rounded as Spark's ``round`` does: halves of the shortest decimal form go away from zero."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def sequential(
    df: DataFrame, key: str, order: list[str], values: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], schema: str
) -> DataFrame:
    """Rows (key, last order column, step's result ...) of ``step(state, values)`` over each key's rows in order.

    One shuffle by key; partitions are sorted and stream through in Arrow batches, with the state of one key at a
    time, so the cost is linear and no key's history is held. ``schema`` names and types what the step returns.
    """
    kinds = dict(df.dtypes)
    shown = order[-1]
    full = f"`{key}` {kinds[key]}, `{shown}` {kinds[shown]}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(full))
    needed = list(dict.fromkeys([key, *order, *values]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            keys, marks = batch.column(key).to_pylist(), batch.column(shown).to_pylist()
            out = []
            for k, row in zip(keys, zip(*[batch.column(v).to_pylist() for v in values], strict=True), strict=True):
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, made = step(state, row)
                out.append(made)
            columns = [pa.array(c, f.type) for c, f in zip([keys, marks, *(zip(*out, strict=True) if out else [[]] * (len(arrow) - 2))], arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*needed).repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, full)
