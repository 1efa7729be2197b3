"""Reports, change flags, safety predicates, state machines and small draws."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import uniform

# Suffixes of code.
CODE_SUFFIXES = ["py", "ts", "js", "sh", "json", "yaml", "yml", "toml"]


@dataclass(frozen=True)
class Places:
    """Where a project keeps what: state files that never count, publishable folders and files, research, notes."""

    state: tuple[str, ...] = ()
    publishable: tuple[str, ...] = ()
    publishable_files: tuple[str, ...] = ()
    research: str = "research/"
    notes: str = "notes/"


# What a command must not contain, and folders that must not change.
DANGEROUS = ["rm -rf /", "rm -rf ~", "rm -rf", "git push --force", "git reset --hard", "DROP TABLE", "DELETE FROM", "curl", "wget"]
PROTECTED = ["/usr", "/etc", "/boot", ".git"]
CYCLE = 6


def change_flags(files: DataFrame, pulse: str | list[str], path: str, places: Places) -> DataFrame:
    """Per pulse: files changed and whether code, publishable or research files or notes are among them."""
    p = F.col(path)
    counted = ~p.isin(list(places.state))
    code = counted & F.lower(F.element_at(F.split(p, r"\."), -1)).isin(CODE_SUFFIXES) & F.contains(p, F.lit("."))
    published = reduce(or_, [p.startswith(f) for f in places.publishable], p.isin(list(places.publishable_files)))
    return files.groupBy(*([pulse] if isinstance(pulse, str) else pulse)).agg(
        F.count_distinct(p).alias("files_changed"), F.bool_or(code).alias("code_changed"), F.bool_or(counted & published).alias("publishable"),
        F.bool_or(counted & p.startswith(places.research)).alias("research"), F.bool_or(F.contains(p, F.lit(places.notes))).alias("notes_written"),
    )


def all_changed(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Files that changed, each once, whether they are tracked or not."""
    return tracked.unionByName(untracked).distinct()


def dangerous_part(command: Column) -> Column:
    """The first listed pattern that a command contains, without regard to case; null if none."""
    low = F.lower(command)
    return F.coalesce(*[F.when(F.contains(low, F.lit(d.lower())), d) for d in DANGEROUS])


def protected(path: Column) -> Column:
    inside = [(path == d) | path.startswith(f"{d}/") | F.contains(path, F.lit(f"/{d}/")) if not d.startswith("/") else (path == d) | path.startswith(f"{d}/") for d in PROTECTED]
    out = inside[0]
    for x in inside[1:]:
        out = out | x
    return out


def last_state(events: DataFrame, key: str, order: str, transitions: dict[str, str], start: str) -> DataFrame:
    """State of every key after its last event; an event outside ``transitions`` changes nothing."""
    state = F.lit(None).cast("string")
    for event, name in transitions.items():
        state = F.when(F.col("event") == event, name).otherwise(state)
    known = events.withColumn("_state", state)
    latest = F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col(order)))
    return known.groupBy(key).agg(F.coalesce(latest, F.lit(start)).alias("state"), F.count("_state").alias("changes"))


def cycles(pulses: DataFrame, stream: str, order: str, invoked: str) -> DataFrame:
    """Add position (1 to 6) and allowed: a wish to invoke passes once a cycle."""
    w = Window.partitionBy(stream).orderBy(order)
    placed = pulses.withColumn("_n", F.row_number().over(w) - 1)
    placed = placed.withColumn("position", F.pmod("_n", F.lit(CYCLE)) + 1).withColumn("_cycle", (F.col("_n") - F.pmod("_n", F.lit(CYCLE))) / CYCLE)
    earlier = F.sum(F.col(invoked).cast("int")).over(Window.partitionBy(stream, "_cycle").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("allowed", F.col(invoked) & (F.coalesce(earlier, F.lit(0)) == 0)).drop("_n", "_cycle")


def texture_profile(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Add scale (0.6 meso, 0.25 micro, 0.15 macro) and count (0.5, 0.35, 0.15 for 1 to 3; 1 for macro); half of the
    meso draws of several turn micro."""
    u, v, h = (uniform(key, seed + i) for i in range(3))
    drawn = F.when(u < 0.6, "meso").when(u < 0.85, "micro").otherwise("macro")
    count = F.when(drawn == "macro", 1).when(v < 0.5, 1).when(v < 0.85, 2).otherwise(3)
    return df.withColumn("count", count).withColumn("scale", F.when((drawn == "meso") & (count > 1) & (h < 0.5), "micro").otherwise(drawn))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {{NAME}} places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def loaded_prompt(static: Column, template: Column, values: dict[str, Column]) -> Column:
    """A prompt from its template, filled, or, where there is none, the static text."""
    return F.coalesce(filled(template, values), static)


def by_mode(registry: DataFrame, kinds: DataFrame, mode: str) -> DataFrame:
    """Entries of a context registry that a mode includes, with their kind."""
    return registry.join(kinds.where((F.col("mode") == mode) & F.col("kind").isNotNull()), "key").drop("mode")


def preview(text: Column, n: int = 300) -> Column:
    flat = F.regexp_replace(F.substring(text, 1, n), "\n", " ")
    return F.when(F.length(text) > n, F.concat(flat, F.lit("..."))).otherwise(flat)


def text_report(best: DataFrame, group: str, families: list[str]) -> DataFrame:
    """One text per group of ranked segments: rank, score with bonus, speaker, families and a preview of each."""
    named = F.array_join(F.filter(F.array(*[F.when(F.col(f"h_{f}") > 0, F.concat(F.lit(f"      - {f} (+"), F.format_number(F.round(f"h_{f}", 1), 1), F.lit(")"))) for f in families]), lambda x: x.isNotNull()), "\n")
    bonus = F.when(F.col("context_bonus") > 0, F.concat(F.lit(" (incl. +"), F.format_number(F.round("context_bonus", 1), 1), F.lit(" context)"))).otherwise("")
    block = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" -- Score: "), F.format_number(F.round("combined", 2), 2), bonus, F.lit("\n    Speaker: "), F.col("speaker"), F.lit("\n"), named, F.lit("\n    Content: "), preview(F.col("text")))
    blocks = best.select(group, "rank", block.alias("block")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("_b"))
    return blocks.select(group, F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n").alias("report"))


def _fired(families: list[str], line: Callable[[str, Column], Column]) -> Column:
    """The lines of the families with a score, in order."""
    return F.filter(F.array(*[F.when(F.col(f"h_{f}") > 0, line(f, F.col(f"h_{f}"))) for f in families]), lambda x: x.isNotNull())


def _ordered(best: DataFrame, group: str, block: Column, between: str) -> DataFrame:
    blocks = best.select(group, F.struct("rank", block.alias("block")).alias("_b")).groupBy(group).agg(F.sort_array(F.collect_list("_b")).alias("_b"))
    return blocks.select(group, F.array_join(F.transform("_b", lambda b: b["block"]), between).alias("report"))


def _one_digit(x: Column) -> Column:
    return F.format_number(F.round(x, 1), 1)


def markdown_report(best: DataFrame, group: str, families: list[str], title: str, most: int = 1000) -> DataFrame:
    """Markdown of each group's ranked segments: score, speaker and lines as a table, families, the text cut at ``most``."""
    c = F.col
    table = F.concat(F.lit("| Property | Value |\n|----------|-------|\n| Speaker | "), c("speaker"), F.lit(" |\n| Lines | "), c("line_start").cast("string"), F.lit("-"), c("line_end").cast("string"), F.lit(" |"))
    bonus = F.when(c("context_bonus") > 0, F.concat(F.lit("\n| Context bonus | +"), _one_digit(c("context_bonus")), F.lit(" |"))).otherwise("")
    fired = F.array_join(_fired(families, lambda f, x: F.concat(F.lit(f"\n- `{f}` (+"), _one_digit(x), F.lit(")"))), "")
    named = F.when(fired != "", F.concat(F.lit("\n\n**Heuristics triggered:**"), fired)).otherwise("")
    content = F.when(F.char_length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n[...truncated...]"))).otherwise(c("text"))
    block = F.concat(F.lit("## #"), c("rank").cast("string"), F.lit(": Score "), F.format_number(F.round("combined", 2), 2), F.lit("\n\n"), table, bonus, named, F.lit("\n\n**Content:**\n```\n"), content, F.lit("\n```\n\n---\n"))
    return _ordered(best, group, block, "\n").withColumn("report", F.concat(F.lit(f"# {title}\n\n"), "report"))


def consolidation_report(best: DataFrame, group: str, families: list[str]) -> DataFrame:
    """A condensed list of each group's ranked segments for notes: speaker, score, families, first line, lines."""
    c = F.col
    fired = F.array_join(_fired(families, lambda f, _: F.lit(f)), ", ")
    line = F.substring_index("text", "\n", 1)
    first = F.when(F.char_length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("..."))).otherwise(line)
    block = F.concat(c("rank").cast("string"), F.lit(". **["), c("speaker"), F.lit("]** (score: "), _one_digit(c("combined")), F.lit(", "), F.when(fired != "", fired).otherwise("none"), F.lit(")\n   > "), first, F.lit("\n   Lines "), c("line_start").cast("string"), F.lit("-"), c("line_end").cast("string"), F.lit("\n"))
    return _ordered(best, group, block, "\n").withColumn("report", F.concat(F.lit("## High-Salience Moments\n\n"), "report"))


def formatted(best: DataFrame, group: str, formatter: Callable[[Column], Column]) -> DataFrame:
    """A report by the caller's own formatter, which makes a text of the array of a group's segments, best first."""
    rows = best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", *[n for n in best.columns if n not in (group, "rank")]))).alias("_s"))
    return rows.select(group, formatter(F.col("_s")).alias("report"))


def json_report(best: DataFrame, columns: list[str]) -> DataFrame:
    return best.select(F.to_json(F.struct(*columns)).alias("entry"))


def run_report(pulses: DataFrame, dialogs: DataFrame, run: str) -> DataFrame:
    """Markdown of each run: counts, then every pulse with the dialogs matched to it, then those matched to none.

    pulses: run, pulse, body; dialogs: run, pulse (null if unmatched), text.
    """
    ordered = lambda key, body: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(body).alias("v")))), lambda x: x["v"]), "\n")
    talks = dialogs.where("pulse IS NOT NULL").groupBy(run, "pulse").agg(ordered("text", "text").alias("talks"))
    bodies = pulses.join(talks, [run, "pulse"], "left").withColumn("part", F.concat_ws("\n", F.concat(F.lit("## Pulse "), F.col("pulse").cast("string")), "body", "talks", F.lit("---")))
    runs = bodies.groupBy(run).agg(F.count("*").alias("_n"), ordered("pulse", "part").alias("_parts"))
    rest = dialogs.where("pulse IS NULL").groupBy(run).agg(ordered("text", "text").alias("_rest"))
    head = F.concat(F.lit("# Run "), F.col(run).cast("string"), F.lit("\n**Pulses:** "), F.col("_n").cast("string"))
    tail = F.when(F.col("_rest").isNotNull(), F.concat(F.lit("## Unmatched dialogs\n"), F.col("_rest")))
    return runs.join(rest, run, "left").select(run, F.concat_ws("\n", head, "_parts", tail).alias("report"))
