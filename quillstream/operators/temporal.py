"""Signals over time: decayed peaks, elevation, baselines, feelings in a row, drives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .folds import half_up

DECAY, HISTORY, ELEVATED, LEAST_HISTORY = 0.85, 50, 1.5, 3
# Seed baselines as type -> signal -> (mean, std), each of weight 5.
SIGNALS = ["meta_commentary", "hedging_ratio", "self_correction", "question_density", "affect_valence", "affect_arousal"]
SEED_COUNT = 5
SEEDS = {
    "infrastructure": [(0.05, 0.04), (0.35, 0.10), (1.0, 1.0), (0.05, 0.04), (0.0, 0.15), (0.35, 0.10)],
    "philosophical": [(0.30, 0.12), (0.55, 0.12), (2.0, 1.5), (0.15, 0.08), (0.10, 0.20), (0.45, 0.12)],
    "companion": [(0.20, 0.15), (0.45, 0.15), (1.5, 1.2), (0.12, 0.08), (0.15, 0.20), (0.50, 0.15)],
    "consolidation": [(0.15, 0.08), (0.30, 0.10), (0.8, 0.8), (0.06, 0.04), (0.05, 0.12), (0.30, 0.10)],
    "exploratory": [(0.20, 0.15), (0.45, 0.15), (1.5, 1.5), (0.10, 0.08), (0.10, 0.20), (0.40, 0.15)],
}


def decayed_peaks(df: DataFrame, stream: str, order: str, values: dict[str, float], segments: int | None = None) -> DataFrame:
    """d_<signal> of every row: max of the value and 0.85 of the last one, rounded to 3 at every step, from a start each.

    The rounding feeds back, but steps compose: rounding is monotone, so after k steps a peak s is the larger of
    what the rows gave by themselves and s decayed and rounded k times, which soon stays as it is.
    """
    names = list(values)

    def step(state: list[float], row: tuple) -> tuple[list[float], tuple]:
        now = [half_up(max(float(x) if x is not None else 0.0, last * DECAY)) for x, last in zip(row, state, strict=True)]
        return now, tuple(now)

    def extend(form: list, row: tuple) -> list:
        steps, own = form
        return [steps + 1, step(own, row)[0] if steps else [half_up(float(x or 0.0)) for x in row]]

    def enter(state: list[float], form: list) -> list[float]:
        steps, own = form
        out = []
        for last, least in zip(state, own, strict=True):
            for _ in range(steps):
                then = half_up(last * DECAY)
                if then == last:
                    break
                last = then
            out.append(max(last, least))
        return out

    schema = ", ".join(f"`d_{v}` double" for v in names)
    rows = scan.segmented(df.select(*dict.fromkeys([stream, order, *names])), stream, [order], segments)
    return scan.composed(rows, stream, order, names, [float(values[v]) for v in names], step, [0, []], extend, enter, schema)


def decayed_peaks_closed(df: DataFrame, stream: str, order: str, value: str, decay: float = DECAY, segments: int | None = None) -> DataFrame:
    """Add peak: the unrounded decayed peak in closed form, for streams of any length.

    Inside a block of steps it is a running maximum of value / decay^t, with t from the start of the block. The blocks are
    so short that the factor stays under 1e142. The end of the earlier block that leads at a row, the one with the largest
    ln(peak) - t * ln(decay), is carried forward by its distance: first the blocks of a segment, then whole segments.
    """
    length = int(325 / max(-math.log(decay), 1e-6))
    fall = F.ln(F.lit(decay))
    lead = lambda t, p: F.struct((F.ln(p) - t * fall).alias("k"), t.alias("t"), p.alias("p"))
    w = scan.inside([stream], [order])
    rows = scan.segmented(df, stream, [order], segments)
    placed = rows.withColumn("_t", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_t") / length))
    placed = placed.withColumn("_r", F.col("_t") - F.col("_b") * length).withColumn("_x", F.col(value) * F.pow(F.lit(1 / decay), F.col("_r")))
    block = F.max("_x").over(Window.partitionBy(scan.SEGMENT, stream, "_b").orderBy(order)) * F.pow(F.lit(decay), F.col("_r"))
    end = F.when((F.col("_r") == length - 1) & (F.col("_p") > 0), lead(F.col("_t"), F.col("_p")))
    led = placed.withColumn("_p", block).withColumn("_e", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = led.withColumn("_p", F.greatest("_p", F.col("_e.p") * F.pow(F.lit(decay), F.col("_t") - F.col("_e.t"))))
    last = F.col("_start") + F.col("n") - 1
    found = scan.carried(
        own, [stream], {"n": F.count("*"), "p": F.max_by("_p", "_t")},
        lambda _, before: {"_start": F.coalesce(F.sum("n").over(before), F.lit(0)), "_best": F.max(F.when(F.col("p") > 0, lead(last, F.col("p")))).over(before)},
    )
    carried = F.col("_best.p") * F.pow(F.lit(decay), F.col("_start") + F.col("_t") - F.col("_best.t"))
    return found.select(*df.columns, F.greatest(F.lit(0.0), "_p", carried).alias("peak"))


def elevation(df: DataFrame, stream: str, order: str, value: str, count_signal: bool = False, segments: int | None = None) -> DataFrame:
    """Add elevated and streak: over 1.5 medians of up to 50 values before (3 at least), and for how many in a row."""
    rows = scan.with_history(scan.segmented(df, stream, [order], segments), [stream], [order], [value], HISTORY)
    past = scan.inside([stream], [order]).rowsBetween(-HISTORY, -1)
    marked = rows.withColumn("_n", F.count(value).over(past)).withColumn("_m", F.expr(f"percentile({value}, 0.5)").over(past)).where("NOT _copy")
    quiet = F.col(value) >= 3 if count_signal else F.col(value) > 0.1
    up = (F.col("_n") >= LEAST_HISTORY) & F.when(F.col("_m") == 0, quiet).otherwise(F.col(value) > ELEVATED * F.col("_m"))
    found = marked.withColumn("elevated", F.coalesce(up, F.lit(False))).select(*df.columns, scan.SEGMENT, "elevated")
    return scan.run_length(found, [stream], [order], "elevated", "streak").drop(scan.SEGMENT)


def run_length(df: DataFrame, stream: str, order: str, flag: str, name: str, segments: int | None = None) -> DataFrame:
    """Number of rows with the flag set in a row up to each row (0 where it is not set)."""
    return scan.run_length(scan.segmented(df, stream, [order], segments), [stream], [order], flag, name).drop(scan.SEGMENT)


def feeling_runs(df: DataFrame, stream: str, order: str, label: str, segments: int | None = None) -> DataFrame:
    """Add in_state (pulses with this label in a row) and previous (the last ten labels, oldest first)."""
    w = scan.inside([stream], [order])
    rows = scan.with_history(scan.segmented(df, stream, [order], segments), [stream], [order], [label], 9)
    same = F.coalesce(F.lag(label).over(w) == F.col(label), F.lit(False))
    seen = rows.withColumn("_same", same).withColumn("previous", F.array_join(F.collect_list(label).over(w.rowsBetween(-9, 0)), ",")).where("NOT _copy").drop("_copy")
    counted = scan.run_length(seen, [stream], [order], "_same", "in_state")
    return counted.select(*df.columns, (F.col("in_state") + 1).alias("in_state"), "previous")


def with_last_observed(df: DataFrame, stream: str, order: str, kind: str, name: str, segments: int | None = None) -> DataFrame:
    """Add the last type seen before each row of a stream."""
    return scan.last_before(scan.segmented(df, stream, [order], segments), [stream], [order], kind, name).drop(scan.SEGMENT)


def with_baseline(df: DataFrame, baselines: DataFrame, kind: str, signal: str, fallback: str = "exploratory") -> DataFrame:
    """Add mean, std and count of a table of baselines (type, signal, mean, std, count) for each row's type and signal;
    an unknown type reads those of ``fallback``."""
    named = baselines.select(F.col("type").alias("_t"), F.col("signal").alias("_s"), F.struct("mean", "std", "count").alias("_b"))
    own = df.join(named, (F.col(kind) == F.col("_t")) & (F.col(signal) == F.col("_s")), "left").drop("_t", "_s")
    spare = named.where(F.col("_t") == fallback).select(F.col("_s").alias("_r"), F.col("_b").alias("_d"))
    both = own.join(spare, F.col(signal) == F.col("_r"), "left").withColumn("_b", F.coalesce("_b", "_d"))
    return both.select(*df.columns, "_b.*")


def baseline_scores(df: DataFrame, stream: str, order: str, kind: str, signals: list[str] = SIGNALS, segments: int | None = None) -> DataFrame:
    """Add z_<signal>: deviation from the running baseline of the row's type, before the row itself updates it.

    Baselines start from the seeds with a weight of 5 and merge all earlier values of stream and type, in closed form
    from sums of their distances from the seed's mean and of the squares, which add up over segments. An unknown
    type starts as exploratory.
    """

    def seed(place: int, which: int) -> Column:
        out = F.lit(SEEDS["exploratory"][place][which])
        for name, rows in SEEDS.items():
            out = F.when(F.col(kind) == name, rows[place][which]).otherwise(out)
        return out

    sums, first = {"_n": F.lit(1)}, {}
    for name in signals:
        first[name] = [seed(SIGNALS.index(name), which) for which in (0, 1)]
        off = F.col(name).cast("double") - first[name][0]
        sums |= {f"_t_{name}": off, f"_q_{name}": off * off}
    found = scan.running_sums(scan.segmented(df, stream, [order], segments), [stream, kind], [order], sums, itself=False)
    count, scores = SEED_COUNT + F.col("_n"), []
    for name in signals:
        mean = F.col(f"_t_{name}") / count  # from the seed's
        squares = F.lit(float(SEED_COUNT)) * first[name][1] * first[name][1] + F.col(f"_q_{name}") - count * mean * mean
        deviation = F.sqrt(F.greatest(F.lit(0.0), squares) / count)
        gap = F.col(name).cast("double") - first[name][0] - mean
        z = F.when(deviation < 0.001, F.when(F.abs(gap) > 0.01, 10.0).otherwise(0.0)).otherwise(F.round(F.round(gap / deviation, 9), 2))
        scores.append(z.alias(f"z_{name}"))
    return found.select(*df.columns, *scores)


def drives(events: DataFrame, stream: str, order: str, segments: int | None = None) -> DataFrame:
    """Levels of three drives after every pulse: (stream, order, building, publishing, experimenting, turns).

    Pulses have code_changed, notes_written, publishable, research, reflective (booleans). Levels rise and decay by
    fixed rates within 0 and 1, in thousandths, so nothing is left to round. Steps compose: each adds and clamps, and so
    do any number of them together (add, least, most).
    """
    fields = ["code_changed", "notes_written", "publishable", "research", "reflective"]

    def moves(row: tuple) -> tuple[int, int, int]:
        code, notes, publishable, research, reflective = row
        return -400 if code else 150, -350 if publishable else 50 if notes else 100, -300 if research else -120 if code else 80 if reflective else -30

    clamp = lambda x, low, high: max(low, min(high, x))

    def step(levels: list[int], row: tuple) -> tuple[list[int], tuple]:
        now = [clamp(x + move, 0, 1000) for x, move in zip(levels, moves(row), strict=True)]
        return now, tuple(x / 1000 for x in now)

    def extend(form: list, row: tuple) -> list:
        return [[add + m, clamp(low + m, 0, 1000), clamp(high + m, 0, 1000)] for (add, low, high), m in zip(form, moves(row), strict=True)]

    def enter(levels: list[int], form: list) -> list[int]:
        return [clamp(x + add, low, high) for x, (add, low, high) in zip(levels, form, strict=True)]

    rows = scan.segmented(events.select(*dict.fromkeys([stream, order, *fields])), stream, [order], segments)
    folded = scan.composed(rows, stream, order, fields, [0, 0, 0], step, [[0, 0, 1000]] * 3, extend, enter, "building double, publishing double, experimenting double")
    return folded.withColumn("turns", turn_budget(F.col("building")))


def turn_budget(building: Column) -> Column:
    """30 turns and up to 15 more as the drive to build goes from 0.3 to 1; halves round to even."""
    return (30 + F.when(building > 0.3, F.bround((building - 0.3) / 0.7 * 15)).otherwise(0.0)).cast("int")
