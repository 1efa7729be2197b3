"""Guards as a stateful stream: budget, rate limit and repeated prompts, decided as the watermark passes each call."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from ..operators.guards import DAY, Guard

SECOND = 1_000_000


CALL = "stream {kind}, at long, number long, amount double, caller string, digest string, full double, rate double"
#: What a guard remembers: spending, prompts and buckets.
MEMORY = (
    "stream {kind}, spent_at array<double>, spent array<long>, asked_at array<double>, asked array<string>, "
    "callers array<string>, tokens array<double>, seen array<double>, full array<double>, rate array<double>"
)
#: Groups that streams are dealt out to; each is one key of the store.
GROUPS = 256


def milliseconds(micros: int) -> int:
    """The first whole millisecond that is not before a time."""
    return -(-micros // 1000)


def packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Rows as the bytes of one Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, schema) as writer:
            writer.write_batch(batch)
        return out.getvalue().to_pybytes()


def unpacked(value: bytes) -> Iterator[tuple]:
    with pa.ipc.open_stream(bytes(value)) as reader:
        for batch in reader:
            yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


class GuardedCalls(StatefulProcessor):
    """Per group of streams: calls that wait for their turn, and what each stream's guard remembers of those it let through.

    Rows come in any order, so a call waits until the watermark says that no earlier one can come. One timer, at the
    earliest call that waits, wakes the group; each stream's waiting calls up to the watermark are decided in order, and
    the timer is set to the earliest of the rest. After each decision what is too old to matter is forgotten; a last
    timer, a day after the last call, clears what is left of quiet streams. Buckets of callers refill, so one that is
    full again is forgotten as well. With ``ttl`` the store also drops state that has not been written for so many
    milliseconds of processing time. An exchange with the store costs far more than the rows it carries, so the
    calls that come together are one packed value, and so are a group's memories, however many streams it has.
    """

    def __init__(self, kind: str, hourly: float, daily: float, most: int, seconds: float, ttl: int | None = None) -> None:
        self.calls, self.guards = (to_arrow_schema(_parse_datatype_string(kinds.format(kind=kind))) for kinds in (CALL, MEMORY))
        self.limits, self.most, self.seconds, self.ttl = (hourly, daily), most, seconds, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "calls binary", self.ttl)
        self.memory = handle.getValueState("memory", "guards binary", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        calls = [(r["stream"], r["at"], r["number"], r["amount"], r["caller"], r["digest"], r["full"], r["rate"]) for r in rows]
        if calls:
            self.waiting.appendValue((packed(calls, self.calls),))
            self.handle.registerTimer(milliseconds(min(c[1] for c in calls)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Of several timers that the watermark has passed, the last one does the work."""
        now = timerValues.getCurrentWatermarkInMs()
        passed = [t for t in self.handle.listTimers() if t <= now]
        if passed and expiredTimerInfo.getExpiryTimeInMs() < max(passed):
            return
        due: dict[Any, dict[tuple, tuple]] = {}
        rest, until, guards = [], now * 1000, self.remembered()
        for call in chain.from_iterable(unpacked(value[0]) for value in self.waiting.get()):
            if call[1] <= until:
                due.setdefault(call[0], {})[call[1:3]] = call[3:]  # a call that came twice counts once
            else:
                rest.append(call)
        last = max((mark[0] for calls in due.values() for mark in calls), default=0)
        for stream, calls in due.items():
            guard = guards.setdefault(stream, Guard(*self.limits, self.most, self.seconds))
            for (at, number), call in sorted(calls.items(), key=lambda c: c[0]):
                errors = guard.decide(at / SECOND, *call)
                yield Row(stream=stream, number=number, allowed=not errors, errors=",".join(errors))
        for guard in guards.values():
            guard.forget(until / SECOND)
        kept = {stream: guard for stream, guard in guards.items() if not guard.empty()}
        self.keep(kept)
        if due:
            self.waiting.put([(packed(rest, self.calls),)]) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(milliseconds(min(c[1] for c in rest)))
        if due and kept:
            self.handle.registerTimer(last // 1000 + (DAY + 1) * 1000)

    def remembered(self) -> dict[Any, Guard]:
        guards, found = {}, self.memory.get()
        for stream, times, amounts, asked, digests, callers, tokens, seen, full, rate in unpacked(found[0]) if found else ():
            buckets = {who: tuple(b) for who, *b in zip(callers, tokens, seen, full, rate, strict=True)}
            guards[stream] = Guard(*self.limits, self.most, self.seconds)
            guards[stream].load(list(zip(times, amounts, strict=True)), buckets, list(zip(asked, digests, strict=True)))
        return guards

    def keep(self, guards: dict[Any, Guard]) -> None:
        """Write back what the guards remember; nothing is left behind of a quiet stream."""
        columns = lambda rows, n: [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(n)]
        rows = []
        for stream, guard in guards.items():
            spent, buckets, prompts = guard.dump()
            rows.append((stream, *columns(spent, 2), *columns(prompts, 2), *columns([(who, *b) for who, b in buckets.items()], 5)))
        self.memory.update((packed(rows, self.guards),)) if rows else self.memory.clear()

    def close(self) -> None:
        pass


def guarded_stream(
    calls: DataFrame, stream: str, caller: str, time: str, order: str, amount: str, digest: str, hourly: float, daily: float, full: Column, rate: Column,
    most: int = 3, seconds: float = 300, late: str = "1 hour", ttl: int | None = None, groups: int = GROUPS,
) -> DataFrame:
    """(stream, order, allowed, errors) of a stream of calls, as ``operators.guards.guarded`` decides them in a batch.

    A call is decided once the watermark, ``late`` behind the latest time seen, has passed it. Calls that come later than
    that are dropped, and counted in the progress of the query; so are rows without a time. Streams are dealt out to
    ``groups``; a task holds the waiting calls of one at a time. The state store must be RocksDB (``windows.ROCKSDB``).
    """
    kinds = dict(calls.dtypes)
    rows = calls.where(F.col(time).isNotNull()).withWatermark(time, late).select(
        time, F.pmod(F.xxhash64(stream), F.lit(groups)).alias("_group"), F.col(stream).alias("stream"), F.unix_micros(time).alias("at"), F.col(order).cast("long").alias("number"), F.col(amount).cast("double").alias("amount"),
        F.col(caller).cast("string").alias("caller"), F.col(digest).cast("string").alias("digest"), full.cast("double").alias("full"), rate.cast("double").alias("rate"),
    )
    schema = f"stream {kinds[stream]}, number long, allowed boolean, errors string"
    found = rows.groupBy("_group").transformWithState(GuardedCalls(kinds[stream], hourly, daily, most, seconds, ttl), schema, "Append", "EventTime")
    return found.select(F.col("stream").alias(stream), F.col("number").cast(kinds[order]).alias(order), "allowed", "errors")
