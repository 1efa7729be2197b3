"""Queries over reports, change flags, safety and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import reports
from ..sources.tables import pick, table
from . import duck, ledger, salience

PATHS = ["src/main.py", "state/session.md", "drafts/a.md", "state/beat.json", "research/x.txt", "files/notes/n.md", "conf/a.YAML", "readme", "vocabulary/shared.md"]
PLACES = reports.Places(("state/session.md", "state/beat.json"), ("drafts/", "site/"), ("vocabulary/shared.md",), "research/", "files/notes/")
COMMANDS = ["ls -la", "sudo rm -rf /tmp", "drop table x", "WGET http://a", "git push", "git reset --hard HEAD", "echo ok"]
TARGETS = ["/usr/lib/a", "/usrlocal/a", "work/.git/config", ".git", "/etc", "home/a.txt"]
EVENTS = {"click": "considering", "purchase": "done", "signup": "fresh"}


def q_change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every event, a user's day being a pulse."""
    files = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), pick(PATHS, F.col("event_id") + F.col("user_id")).alias("path"))
    return reports.change_flags(files, ["user_id", "day"], "path", PLACES)


def q_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select("user_id", "event_type", pick(PATHS, F.col("event_id")).alias("path"))
    kinds = [paths.where(F.col("event_type") == kind).select("user_id", "path") for kind in ("click", "error")]
    return reports.all_changed(*kinds)


def q_prompt_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.when(F.pmod("c_custkey", F.lit(3)) > 0, F.concat(F.lit("For {{WHO}} of "), F.lower("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", reports.loaded_prompt(F.lit("static text"), template, {"WHO": F.col("c_name")}).alias("prompt"))


def q_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", pick(COMMANDS, F.col("event_id")).alias("c"), pick(TARGETS, F.col("event_id")).alias("p"))
    return rows.select("event_id", reports.dangerous_part(F.col("c")).alias("pattern"), reports.protected(F.col("p")).alias("protected"))


def q_inbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("event"))
    return reports.last_state(events, "user_id", "event_id", EVENTS, "new")


def q_cycle_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulses = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("wish"))
    return reports.cycles(pulses, "user_id", "event_id", "wish").select("event_id", F.col("position").cast("int"), "allowed")


def q_texture_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.texture_profile(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 5)


def q_template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("Dear {{WHO}}, {{N}} items of {{WHAT}}. {{WHO}}!")
    values = {"WHO": F.col("c_name"), "N": F.col("c_nationkey").cast("string"), "WHAT": F.lower("c_mktsegment")}
    return table(spark, sf_dir, "customer").select("c_custkey", reports.filled(template, values).alias("filled"))


def q_mode_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("path"))
    modes = spark.createDataFrame([("full", 1), ("light", 2)], "mode string, m int")
    kind = F.when(F.pmod(F.col("key") * F.col("m"), F.lit(3)) == 0, "pointer").when(F.pmod(F.col("key") + F.col("m"), F.lit(3)) == 1, "template")
    kinds = registry.select("key").crossJoin(F.broadcast(modes)).select("key", "mode", kind.alias("kind"))
    return reports.by_mode(registry, kinds, "light")


def q_salience_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("combined"), "turn"))
    best = salience.with_context(spark, sf_dir).withColumn("rank", place).where("rank <= 3").withColumn("speaker", F.col("role"))
    found = reports.text_report(best, "conv_id", [n for n, _, _ in salience.FAMILIES])
    return found.select("conv_id", F.length("report").alias("chars"), F.md5("report").alias("digest"))


def best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best turns of each conversation, with lines as if each turn had three."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("combined"), "turn"))
    best = salience.with_context(spark, sf_dir).withColumn("rank", place).where("rank <= 3").withColumn("speaker", F.col("role"))
    return best.withColumn("line_start", F.col("turn") * 3).withColumn("line_end", F.col("turn") * 3 + 2)


def q_markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.markdown_report(best_segments(spark, sf_dir), "conv_id", [n for n, _, _ in salience.FAMILIES], "Saliency", 400)
    return found.select("conv_id", F.md5("report").alias("digest"))


def q_consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.consolidation_report(best_segments(spark, sf_dir), "conv_id", [n for n, _, _ in salience.FAMILIES])
    return found.select("conv_id", F.md5("report").alias("digest"))


def q_custom_formatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formatter of a user: speakers and turns, best first."""
    best = best_segments(spark, sf_dir).select("conv_id", "rank", "speaker", "turn")
    return reports.formatted(best, "conv_id", lambda s: F.array_join(F.transform(s, lambda x: F.concat(x["speaker"], F.lit("@"), x["turn"].cast("string"))), " > "))


def q_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user as pulses, errors as dialogs, matched as in dialog_match but by user."""
    from ..operators import relate

    events = table(spark, sf_dir, "events")
    logs = events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    pulses = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pulse"), F.col("ts").alias("pulse_ts"))
    matched = relate.interval_match(logs, pulses, ["user_id"], "event_id", "pulse", "ts", "pulse_ts", 7200)
    dialogs = logs.join(matched, ["user_id", "event_id"], "left").select("user_id", "pulse", F.concat(F.lit("dialog "), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("text"))
    found = reports.run_report(pulses.select("user_id", "pulse", F.lit("body").alias("body")), dialogs, "user_id")
    return found.select("user_id", F.md5("report").alias("digest"), F.length("report").alias("chars"))


def q_spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.ledger(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"))
    return found


def oracles() -> dict[str, str]:
    choose = lambda values, index: f"({duck.array(values)})[(({index}) % {len(values)} + 1)::BIGINT]"
    danger = "CASE " + " ".join(f"WHEN contains(lower(c), {duck.lit(d.lower())}) THEN {duck.lit(d)}" for d in reports.DANGEROUS) + " END"
    to_state = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in EVENTS.items()) + " END"
    seg = f"{duck.TALKS}, {salience.salience_sql('talks', 'conv_id, turn, role, text')}"
    fam = ", ".join(f"CASE WHEN h_{n} > 0 THEN '      - {n} (+' || format('{{:.1f}}', floor(h_{n} * 10 + 0.500000001) / 10) || ')' END" for n, _, _ in salience.FAMILIES)
    ranked = f"""{seg}, strong AS (SELECT *, CASE WHEN salience > 3 THEN salience ELSE 0 END AS s FROM seg),
ctx AS (SELECT *, round(0.3 * coalesce(lead(s) OVER w, 0) + 0.15 * coalesce(lag(s) OVER w, 0), 6)::DOUBLE AS bonus FROM strong WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, round(salience + bonus, 6) AS combined, row_number() OVER (PARTITION BY conv_id ORDER BY round(salience + bonus, 6) DESC, turn) AS rank FROM ctx)"""
    digit = lambda x: f"format('{{:.1f}}', floor({x} * 10 + 0.500000001) / 10)"
    fired = lambda line: ", ".join(f"CASE WHEN h_{n} > 0 THEN {line(n)} END" for n, _, _ in salience.FAMILIES)
    marked = fired(lambda n: f"chr(10) || '- `{n}` (+' || {digit(f'h_{n}')} || ')'")
    named = fired(lambda n: f"'{n}'")
    first = "string_split(text, chr(10))[1]"
    found = {
        "change_flags": f"""WITH f AS (SELECT user_id, ts::DATE AS day, {choose(PATHS, 'event_id + user_id')} AS p FROM events), g AS (SELECT *, NOT list_contains({duck.array(list(PLACES.state))}, p) AS k FROM f)
SELECT user_id, day, count(DISTINCT p) AS files_changed, bool_or(k AND regexp_matches(lower(p), '\\.({'|'.join(reports.CODE_SUFFIXES)})$')) AS code_changed, bool_or(k AND (regexp_matches(p, '^({'|'.join(PLACES.publishable)})') OR list_contains({duck.array(list(PLACES.publishable_files))}, p))) AS publishable, bool_or(k AND starts_with(p, '{PLACES.research}')) AS research, bool_or(contains(p, '{PLACES.notes}')) AS notes_written FROM g GROUP BY user_id, day""",
        "changed_files": f"SELECT DISTINCT user_id, {choose(PATHS, 'event_id')} AS path FROM events WHERE event_type IN ('click', 'error')",
        "prompt_loading": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'For ' || c_name || ' of ' || lower(c_mktsegment) ELSE 'static text' END AS prompt FROM customer",
        "safety": f"WITH r AS (SELECT event_id, {choose(COMMANDS, 'event_id')} AS c, {choose(TARGETS, 'event_id')} AS p FROM events) SELECT event_id, {danger} AS pattern, regexp_matches(p, '^/(usr|etc|boot)(/|$)') OR regexp_matches(p, '(^|/)\\.git/') OR p = '.git' AS protected FROM r",
        "inbox_states": f"WITH s AS (SELECT user_id, event_id, {to_state} AS s FROM events) SELECT user_id, coalesce(arg_max(s, event_id) FILTER (s IS NOT NULL), 'new') AS state, count(s) AS changes FROM s GROUP BY user_id",
        "cycle_position": "WITH n AS (SELECT *, event_type = 'view' AS wish, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), e AS (SELECT *, coalesce(sum(wish::INT) OVER (PARTITION BY user_id, n // 6 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT event_id, (n % 6 + 1)::INT AS position, wish AND before = 0 AS allowed FROM e",
        "template_fill": "SELECT c_custkey, 'Dear ' || c_name || ', ' || c_nationkey || ' items of ' || lower(c_mktsegment) || '. ' || c_name || '!' AS filled FROM customer",
        "mode_projection": "SELECT * FROM (SELECT n_nationkey AS key, n_name AS path, CASE WHEN n_nationkey * 2 % 3 = 0 THEN 'pointer' WHEN (n_nationkey + 2) % 3 = 1 THEN 'template' END AS kind FROM nation) WHERE kind IS NOT NULL",
        "salience_report": f"""WITH {ranked},
b AS (SELECT conv_id, rank, '#' || rank || ' -- Score: ' || format('{{:.2f}}', floor(combined * 100 + 0.500000001) / 100) || CASE WHEN bonus > 0 THEN ' (incl. +' || format('{{:.1f}}', floor(bonus * 10 + 0.500000001) / 10) || ' context)' ELSE '' END || chr(10) || '    Speaker: ' || role || chr(10) || coalesce(array_to_string(list_filter([{fam}], lambda x: x IS NOT NULL), chr(10)), '') || chr(10) || '    Content: ' || replace(substr(text, 1, 300), chr(10), ' ') || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS block FROM r WHERE rank <= 3),
g AS (SELECT conv_id, array_to_string(list(block ORDER BY rank), chr(10) || chr(10)) AS report FROM b GROUP BY conv_id) SELECT conv_id, length(report)::INT AS chars, md5(report) AS digest FROM g""",
        "run_report": """WITH l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id AS pulse, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT l.user_id, l.event_id, min(pulse) AS pulse FROM l LEFT JOIN p ON p.user_id = l.user_id AND abs(epoch_us(p.ts) - epoch_us(l.ts)) < 7200000000 GROUP BY ALL),
d AS (SELECT user_id, pulse, 'dialog ' || lpad(event_id::VARCHAR, 9, '0') AS text FROM m), t AS (SELECT user_id, pulse, string_agg(text, chr(10) ORDER BY text) AS talks FROM d WHERE pulse IS NOT NULL GROUP BY ALL),
b AS (SELECT p.user_id, p.pulse, concat_ws(chr(10), '## Pulse ' || p.pulse, 'body', talks, '---') AS part FROM p LEFT JOIN t ON t.user_id = p.user_id AND t.pulse = p.pulse),
r AS (SELECT user_id, count(*) AS n, string_agg(part, chr(10) ORDER BY pulse) AS parts FROM b GROUP BY user_id), u AS (SELECT user_id, string_agg(text, chr(10) ORDER BY text) AS rest FROM d WHERE pulse IS NULL GROUP BY user_id),
x AS (SELECT r.user_id, concat_ws(chr(10), '# Run ' || r.user_id || chr(10) || '**Pulses:** ' || n, parts, '## Unmatched dialogs' || chr(10) || rest) AS report FROM r LEFT JOIN u USING (user_id))
SELECT user_id, md5(report) AS digest, length(report)::INT AS chars FROM x""",
        "spend_by_model": f"WITH {ledger.oracles()['rolling_spend'].split('WITH ')[1].split(', s AS')[0]} SELECT event_type, round(sum(cost), 6) AS cost, count(*) AS calls FROM l GROUP BY event_type",
    }
    found["markdown_report"] = f"""WITH {ranked}, n AS (SELECT *, array_to_string(list_filter([{marked}], lambda x: x IS NOT NULL), '') AS fired FROM r WHERE rank <= 3),
b AS (SELECT conv_id, rank, '## #' || rank || ': Score ' || format('{{:.2f}}', floor(combined * 100 + 0.500000001) / 100) || chr(10) || chr(10) || '| Property | Value |' || chr(10) || '|----------|-------|' || chr(10) || '| Speaker | ' || role || ' |' || chr(10) || '| Lines | ' || (turn * 3) || '-' || (turn * 3 + 2) || ' |' || CASE WHEN bonus > 0 THEN chr(10) || '| Context bonus | +' || {digit('bonus')} || ' |' ELSE '' END
|| CASE WHEN coalesce(fired, '') <> '' THEN chr(10) || chr(10) || '**Heuristics triggered:**' || fired ELSE '' END || chr(10) || chr(10) || '**Content:**' || chr(10) || '```' || chr(10) || CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '[...truncated...]' ELSE text END || chr(10) || '```' || chr(10) || chr(10) || '---' || chr(10) AS block FROM n)
SELECT conv_id, md5('# Saliency' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY rank)) AS digest FROM b GROUP BY conv_id"""
    found["consolidation_report"] = f"""WITH {ranked}, n AS (SELECT *, array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ', ') AS fired FROM r WHERE rank <= 3),
b AS (SELECT conv_id, rank, rank || '. **[' || role || ']** (score: ' || {digit('combined')} || ', ' || CASE WHEN coalesce(fired, '') <> '' THEN fired ELSE 'none' END || ')' || chr(10) || '   > ' || CASE WHEN length({first}) > 100 THEN substr({first}, 1, 100) || '...' ELSE {first} END || chr(10) || '   Lines ' || (turn * 3) || '-' || (turn * 3 + 2) || chr(10) AS block FROM n)
SELECT conv_id, md5('## High-Salience Moments' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY rank)) AS digest FROM b GROUP BY conv_id"""
    found["custom_formatter"] = f"WITH {ranked} SELECT conv_id, string_agg(role || '@' || turn, ' > ' ORDER BY rank) AS report FROM r WHERE rank <= 3 GROUP BY conv_id"
    uniform = lambda seed: f"((('0x' || substr(md5(event_id || '|' || {seed}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656)"
    found["texture_profile"] = f"""WITH d AS (SELECT event_id, CASE WHEN {uniform(5)} < 0.6 THEN 'meso' WHEN {uniform(5)} < 0.85 THEN 'micro' ELSE 'macro' END AS drawn FROM events),
c AS (SELECT *, CASE WHEN drawn = 'macro' THEN 1 WHEN {uniform(6)} < 0.5 THEN 1 WHEN {uniform(6)} < 0.85 THEN 2 ELSE 3 END AS count FROM d) SELECT event_id, count::INT AS count, CASE WHEN drawn = 'meso' AND count > 1 AND {uniform(7)} < 0.5 THEN 'micro' ELSE drawn END AS scale FROM c"""
    return found
