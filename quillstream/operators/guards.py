"""Guardrails over event ledgers: rolling spend, admission, token buckets, repeated prompts, circuit breakers."""

from __future__ import annotations

from collections import Counter, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import python_regex
from .folds import half_up, sequential

HOUR, DAY = 3600, 86400


def seconds_before(stream: str, time: str, seconds: float, itself: bool = True) -> Window:
    """Rows of a stream within the last ``seconds``, that far back excluded."""
    w = Window.partitionBy(stream).orderBy(F.unix_micros(time))
    return w.rangeBetween(-int(seconds * 1_000_000) + 1, 0 if itself else -1)


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price of a call by model; unknown models cost as ``default``, which is 1 and 2 a million tokens if not set."""
    default = prices.get("default", (1.0, 2.0))
    rate = lambda k: F.coalesce(*[F.when(model == m, p[k]) for m, p in prices.items()], F.lit(default[k]))
    return tokens_in / 1e6 * rate(0) + tokens_out / 1e6 * rate(1)


def rolling_spend(ledger: DataFrame, stream: str, time: str, amount: str) -> DataFrame:
    """Add hourly and daily: spend within the last hour and day, this record included."""
    return ledger.withColumn("hourly", F.sum(amount).over(seconds_before(stream, time, HOUR))).withColumn("daily", F.sum(amount).over(seconds_before(stream, time, DAY)))


def budget_status(spend: DataFrame, hourly_limit: float, daily_limit: float, warn: float = 0.75) -> DataFrame:
    """Add percentages, what remains, and a warning text where spend passes 75 % of a limit."""
    message = lambda name, c, limit: F.when(F.col(c) > warn * limit, F.concat(F.lit(f"{name} budget at "), F.round(F.col(c) / limit * 100).cast("int").cast("string"), F.lit("%")))
    return (
        spend.withColumn("hourly_percent", F.round(F.col("hourly") / hourly_limit * 100, 3))
        .withColumn("daily_percent", F.round(F.col("daily") / daily_limit * 100, 3))
        .withColumn("hourly_left", F.round(F.greatest(F.lit(0.0), hourly_limit - F.col("hourly")), 6))
        .withColumn("daily_left", F.round(F.greatest(F.lit(0.0), daily_limit - F.col("daily")), 6))
        .withColumn("warnings", F.concat_ws("; ", message("Hourly", "hourly", hourly_limit), message("Daily", "daily", daily_limit)))
    )


def prompt_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text with its white space normalised."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, python_regex(r"\s+", ""), F.lit(" "))), F.lit("^ | $"), F.lit(""))
    return F.substring(F.sha2(plain, 256), 1, 16)


def repeated_prompts(prompts: DataFrame, digest: str, time: str, most: int = 3, seconds: float = 300) -> DataFrame:
    """Add earlier (same prompts in the time before, by anyone) and blocked (as many as ``most``).

    Prompts lie in buckets of that time and are copied to the next one, so a bucket holds all that its own look back
    to; the rows of a frequent prompt are dealt out by its buckets.
    """
    bucket = F.floor(F.unix_micros(time) / int(seconds * 1_000_000))
    copies = prompts.withColumn("_copy", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_bucket", bucket + F.col("_copy").cast("long"))
    w = Window.partitionBy(digest, "_bucket").orderBy(F.unix_micros(time)).rangeBetween(-int(seconds * 1_000_000) + 1, -1)
    counted = copies.withColumn("earlier", F.count("*").over(w)).where("NOT _copy").drop("_copy", "_bucket")
    return counted.withColumn("blocked", F.col("earlier") >= most)


def token_bucket(calls: DataFrame, subsystem: str, time: str, order: str, per_minute: Column, burst: Column) -> DataFrame:
    """Admission by a token bucket per subsystem: (subsystem, order, allowed, tokens, wait).

    A bucket starts full (limit plus burst) and refills with elapsed time; a rejection takes nothing, which later
    calls depend on, so it is a fold over the subsystem's calls in order.
    """
    at = (F.unix_micros(time) / 1e6).alias("_at")
    rows = calls.select(subsystem, order, at, per_minute.cast("double").alias("_limit"), burst.cast("double").alias("_burst"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        now, limit, extra = row
        full, rate = limit + extra, limit / 60
        have = full if state is None else min(full, state[0] + (now - state[1]) * rate)
        allowed = have >= 1
        left = have - 1 if allowed else have
        return (left, now), (allowed, half_up(left, 6), 0.0 if allowed else half_up((1 - have) / rate, 6))

    return sequential(rows, subsystem, ["_at", order], ["_at", "_limit", "_burst"], lambda: None, step, "allowed boolean, tokens double, wait double")


NANO = 1_000_000_000


class Spend:
    """Admitted amounts of the last hour and day, in billionths so that sums are exact, with running totals."""

    def __init__(self) -> None:
        self.kept = {HOUR: deque(), DAY: deque()}
        self.total = {HOUR: 0, DAY: 0}

    def forget(self, now: float) -> None:
        for width, rows in self.kept.items():
            while rows and rows[0][0] <= now - width:
                self.total[width] -= rows.popleft()[1]

    def over(self, amount: int, hourly: int, daily: int) -> str | None:
        return "Hourly" if self.total[HOUR] + amount > hourly else "Daily" if self.total[DAY] + amount > daily else None

    def add(self, now: float, amount: int) -> None:
        for width, rows in self.kept.items():
            rows.append((now, amount))
            self.total[width] += amount


def _billionths(amount: float | None) -> int:
    return round((amount or 0.0) * NANO)


def budget_admission(calls: DataFrame, stream: str, time: str, order: str, amount: str, hourly: float, daily: float) -> DataFrame:
    """(stream, order, verdict): calls in order, recorded only if neither the hour's nor the day's limit would be passed.

    What was admitted decides what follows, so it is a fold; the state is the admitted calls of the last day.
    """
    rows = calls.select(stream, order, (F.unix_micros(time) / 1e6).alias("_at"), F.col(amount).cast("double").alias("_amount"))
    limits = _billionths(hourly), _billionths(daily)

    def step(spend: Spend, row: tuple) -> tuple[Spend, tuple]:
        now, cost = row[0], _billionths(row[1])
        spend.forget(now)
        verdict = spend.over(cost, *limits)
        if verdict is None:
            spend.add(now, cost)
        return spend, (verdict or "ok",)

    return sequential(rows, stream, ["_at", order], ["_at", "_amount"], Spend, step, "verdict string")


def limit_of(subsystem: Column, limits: dict[str, dict[str, float]]) -> tuple[Column, Column]:
    """Full bucket and refill a second of a subsystem: its own limits, else those of ``general``, else 10 a minute.

    Limits have per_minute or per_hour (10 a minute without either) and burst_allowance, which only fills the bucket.
    """

    def found(limit: dict[str, float]) -> tuple[float, float]:
        count, seconds = (limit["per_minute"], 60.0) if "per_minute" in limit else (limit["per_hour"], 3600.0) if "per_hour" in limit else (10.0, 60.0)
        return float(count + limit.get("burst_allowance", 0)), count / seconds

    full, rate = (F.lit(x) for x in found(limits.get("general", {})))
    for name, limit in limits.items():
        own = found(limit)
        full, rate = F.when(subsystem == name, own[0]).otherwise(full), F.when(subsystem == name, own[1]).otherwise(rate)
    return full, rate


def rate_status(tokens: DataFrame, subsystem: str, order: str, time: str, on: Column, full: Column, rate: Column) -> DataFrame:
    """Per subsystem the tokens that its bucket has at a time, and what percentage of the full bucket that is."""
    last = tokens.groupBy(subsystem).agg(F.max_by(F.struct(F.col("tokens").alias("t"), F.col(time).alias("at"), full.alias("full"), rate.alias("rate")), order).alias("_l"))
    waited = (F.unix_micros(on) - F.unix_micros("_l.at")) / 1e6
    have = F.least(F.col("_l.full"), F.col("_l.t") + waited * F.col("_l.rate"))
    return last.select(subsystem, F.round(have, 6).alias("available"), F.round(have / F.col("_l.full") * 100, 3).alias("percent"))


class Guard:
    """Budget, rate limits of callers and repeated prompts of one stream; what it lets through it remembers."""

    def __init__(self, hourly: float, daily: float, most: int, seconds: float) -> None:
        self.limits, self.most, self.seconds = (_billionths(hourly), _billionths(daily)), most, seconds
        self.spend, self.buckets, self.prompts, self.seen = Spend(), {}, deque(), Counter()

    def forget(self, now: float) -> None:
        """Drop what can no longer matter: spending of over a day, prompts out of sight, buckets that are full again."""
        self.spend.forget(now)
        while self.prompts and self.prompts[0][0] <= now - self.seconds:
            gone = self.prompts.popleft()[1]
            self.seen[gone] -= 1
            if not self.seen[gone]:
                del self.seen[gone]
        self.buckets = {who: b for who, b in self.buckets.items() if b[0] + (now - b[1]) * b[3] < b[2]}

    def decide(self, now: float, amount: float | None, who: str, prompt: str, full: float, rate: float) -> list[str]:
        """What is against a call; without anything it spends, takes a token and is remembered."""
        cost = _billionths(amount)
        self.spend.forget(now)
        while self.prompts and self.prompts[0][0] <= now - self.seconds:
            self.seen[self.prompts.popleft()[1]] -= 1
        tokens, before, *_ = self.buckets.get(who, (full, now))
        tokens = min(full, tokens + (now - before) * rate)
        over = self.spend.over(cost, *self.limits)
        errors = [e for e, failed in ((over and over.lower(), over), ("rate", tokens < 1), ("loop", self.seen[prompt] >= self.most)) if failed]
        if not errors:
            self.spend.add(now, cost)
            tokens -= 1
            self.prompts.append((now, prompt))
            self.seen[prompt] += 1
        self.buckets[who] = (tokens, now, full, rate)
        return errors

    def load(self, spent: list[tuple[float, int]], buckets: dict[str, tuple], prompts: list[tuple[float, str]]) -> None:
        for at, amount in spent:
            self.spend.add(at, amount)
        self.buckets, self.prompts, self.seen = dict(buckets), deque(prompts), Counter(p for _, p in prompts)

    def dump(self) -> tuple[list[tuple[float, int]], dict[str, tuple], list[tuple[float, str]]]:
        return list(self.spend.kept[DAY]), self.buckets, list(self.prompts)

    def empty(self) -> bool:
        return not (self.spend.kept[DAY] or self.buckets or self.prompts)


def guarded(
    calls: DataFrame, stream: str, caller: str, time: str, order: str, amount: str, digest: str, hourly: float, daily: float, full: Column, rate: Column,
    most: int = 3, seconds: float = 300,
) -> DataFrame:
    """(stream, order, allowed, errors): each call held against budget, rate limit of its caller and repeated prompts.

    All that fail are named (``hourly`` or ``daily``, ``rate``, ``loop``); only an allowed call spends, takes a token
    and is remembered as a prompt, so it is a fold over the stream's calls in order. ``streaming.guards`` decides the
    same calls as they come.
    """
    at = (F.unix_micros(time) / 1e6).alias("_at")
    rows = calls.select(stream, order, at, F.col(amount).cast("double").alias("_amount"), F.col(caller).alias("_caller"), F.col(digest).alias("_digest"), full.alias("_full"), rate.alias("_rate"))

    def step(guard: Guard, row: tuple) -> tuple[Guard, tuple]:
        errors = guard.decide(*row)
        return guard, (not errors, ",".join(errors))

    columns = ["_at", "_amount", "_caller", "_digest", "_full", "_rate"]
    return sequential(rows, stream, ["_at", order], columns, lambda: Guard(hourly, daily, most, seconds), step, "allowed boolean, errors string")


def recent(records: DataFrame, time: str, now: Column, seconds: float) -> DataFrame:
    """Records up to a time that are younger than ``seconds`` then: what a pruned state still has."""
    age = F.unix_micros(now) - F.unix_micros(time)
    return records.where((age >= 0) & (age < int(seconds * 1_000_000)))


def near_repeats(prompts: DataFrame, digest: str, most: int = 3) -> DataFrame:
    """Digests that are one short of a loop or over it, with their counts."""
    return prompts.groupBy(digest).agg(F.count("*").alias("n")).where(F.col("n") >= most - 1)


def without_subsystem(records: DataFrame, subsystem: str, name: str | None = None) -> DataFrame:
    """Records after a reset of one subsystem, or of all."""
    return records.limit(0) if name is None else records.where(~F.col(subsystem).eqNullSafe(F.lit(name)))


def circuit_breaker(calls: DataFrame, stream: str, order: str, failed: str) -> DataFrame:
    """Add failures (in a row, up to each call), cooldown (0, then 3, 6, 12 ... 48 calls from the second on) and open."""
    w = Window.partitionBy(stream).orderBy(order)
    place = F.row_number().over(w)
    counted = calls.withColumn("_place", place).withColumn("_ok", F.max(F.when(~F.col(failed), F.col("_place"))).over(w))
    failures = F.col("_place") - F.coalesce("_ok", F.lit(0))
    cooldown = F.when(F.col("failures") < 2, 0).otherwise(F.least(F.lit(48), (3 * F.pow(2, F.least(F.lit(10), F.col("failures") - 2))).cast("int")))
    return counted.withColumn("failures", failures).withColumn("cooldown", cooldown).withColumn("open", F.col("failures") >= 2).drop("_place", "_ok")
