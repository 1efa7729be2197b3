"""Queries over companions: availability, health, cycles, intrusions, dialogs, activity and inbox texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, companions, reports
from ..sources import files
from ..sources.tables import pick, table
from . import duck

NAMES = {"alpha": ["click", "view", "error"], "beta": ["purchase", "view"], "gamma": ["signup", "error"]}
NOTES = ["No carry note yet. " + "x" * 120, "short", "  A line to carry over: " + "the thread of the last talk goes on " * 4 + " \n"]


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pulses of a companion: errors and views failed, clicks called nobody, the rest went well."""
    failed = F.when(F.col("event_type").isin("error", "view"), True).when(F.col("event_type") != "click", False)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", failed.alias("failed"))


def q_companion_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = companions.availability(pulses(spark, sf_dir), "user_id", "event_id", "failed")
    return found.select("event_id", F.col("pulse").cast("int"), "failures", "available")


def q_companion_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companions.health(pulses(spark, sf_dir), "user_id", "event_id", "failed", "ts")


def q_cycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("wish"))
    found = companions.cycle_status(reports.cycles(rows, "user_id", "event_id", "wish"), "user_id", "event_id")
    return found.select("event_id", "invocation_available", F.col("until_reset").cast("int"))


def q_intrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.filter(F.array(*[F.when(F.col("event_type").isin(kinds), name) for name, kinds in NAMES.items()]), lambda n: n.isNotNull())
    rows = table(spark, sf_dir, "events").select("event_id", names.alias("names"))
    return companions.intrusions(rows, ["event_id"], "names", 21).where("companion IS NOT NULL").select("event_id", "companion")


def q_carry_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.pmod("doc_id", F.lit(4)) == 3, F.col("text")).otherwise(pick(NOTES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(companions.carried(note)).alias("digest"))


def q_dialog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    dialogs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("dialog"))
    text = companions.dialog_text(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.pmod("conv_id", F.lit(2)) == 1, F.lit("2024-01-01"), F.col("dialog"), "assistant")
    return dialogs.select("conv_id", F.md5(text).alias("digest"))


def q_quick_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("name"), (F.pmod("user_id", F.lit(9)) + 1).alias("pulses"))
    return companions.quick_summary(logs, "user_id", "name", F.col("pulses"))


def q_companion_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    logs = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("log_ts"))
    return companions.active_since(events.where("event_type = 'purchase'"), logs, "user_id", "ts", "log_ts").select("event_id")


def q_inbox_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select(F.pmod("page_id", F.lit(40)).alias("box"), F.concat(F.lit("item_"), F.col("page_id").cast("string")).alias("filename"), pick(["fresh", "considering", "done", "done"], F.floor(F.col("page_id") / 3)).alias("status"))
    return companions.inbox_section(items, "box").select("box", F.md5("section").alias("digest"))


def q_tool_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("[Tool: Read a]\n\n\n\nthen [Tool: x][broken\n"), "text", F.lit("\n\n\n[Tool: Write]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(companions.without_tool_markers(text)).alias("digest"))


def q_vocabulary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = "## Part I: Terms", "## Part II:"
    k = F.pmod("doc_id", F.lit(4))
    text = F.when(k == 0, F.col("text")).otherwise(F.concat(F.lit("intro\n"), F.lit(first), F.lit("\n"), F.col("text"), F.when(k > 1, F.lit(f"\n\n{second} more\nrest")).otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(companions.vocabulary(text, first, second, 900)).alias("digest"))


def q_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", companions.session_id(F.col("ts")).alias("session_id"))


def q_logs_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs by the time in their names, some of which are malformed."""
    name = F.when(F.pmod("event_id", F.lit(9)) > 0, F.concat(F.date_format("ts", "yyyy-MM-dd_HHmmss"), F.lit("_x.json"))).otherwise("2024-99-01_000000_x.json")
    logs = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return files.in_range(logs, "name", "2024-01-10 00:00:00", "2024-01-12 12:00:00").select("event_id", "at")


FEELINGS = ["curious", "frustrated", "content", "bored"]


def q_latest_feeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click or view with its user's latest feeling at the time, from the other events, if it is under two days old."""
    events = table(spark, sf_dir, "events")
    felt = events.where("event_type NOT IN ('click', 'view')").select("user_id", "event_id", "ts", pick(FEELINGS, F.col("event_id")).alias("feeling"), F.col("ts").alias("felt_at"))
    messages = events.where("event_type IN ('click', 'view')").select("user_id", "event_id", "ts")
    return asof.latest_before(messages, felt, "user_id", "ts", "ts", ["feeling", "felt_at"], 2 * 86400, "event_id")


def oracles() -> dict[str, str]:
    nl = "chr(10)"
    draw = duck.draw
    wait = "CASE WHEN failures < 2 THEN 0 ELSE least(48, 3 * 2 ** least(10, failures - 2)) END::INT"
    base = "p AS (SELECT *, CASE WHEN event_type IN ('error', 'view') THEN true WHEN event_type <> 'click' THEN false END AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pulse FROM events)"
    past = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    names = "list_filter([" + ", ".join(f"CASE WHEN event_type IN ({', '.join(map(duck.lit, kinds))}) THEN '{n}' END" for n, kinds in NAMES.items()) + "], lambda n: n IS NOT NULL)"
    note = f"CASE WHEN doc_id % 4 = 3 THEN text ELSE ({duck.array(NOTES)})[(doc_id % {len(NOTES)} + 1)::BIGINT] END"
    markers = f"'[Tool: Read a]' || {nl} || {nl} || {nl} || {nl} || 'then [Tool: x][broken' || {nl} || text || {nl} || {nl} || {nl} || '[Tool: Write]'"
    return {
        "latest_feeling": f"""WITH f AS (SELECT user_id, ts, arg_max(event_id, event_id) AS felt FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY user_id, ts),
m AS (SELECT e.user_id, e.event_id, e.ts, felt, f.ts AS felt_ts FROM (SELECT * FROM events WHERE event_type IN ('click', 'view')) e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts)
SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(felt_ts) < 172800000000 THEN ({duck.array(FEELINGS)})[(felt % {len(FEELINGS)} + 1)::BIGINT] END AS feeling, CASE WHEN epoch_us(ts) - epoch_us(felt_ts) < 172800000000 THEN felt_ts END AS felt_at FROM m""",
        "companion_availability": f"""WITH {base}, c AS (SELECT *, max(CASE WHEN failed THEN pulse END) {past} AS last, coalesce(max(CASE WHEN NOT failed THEN pulse END) {past}, 0) AS good FROM p),
f AS (SELECT a.event_id, a.pulse, a.last, (SELECT count(*) FROM p b WHERE b.user_id = a.user_id AND b.failed AND b.pulse < a.pulse AND b.pulse > a.good)::INT AS failures FROM c a)
SELECT event_id, pulse::INT AS pulse, failures, failures < 2 OR pulse - last >= {wait} AS available FROM f""",
        "companion_health": f"""WITH {base}, g AS (SELECT user_id, max(pulse) AS n, max(pulse) FILTER (failed) AS bad, coalesce(max(pulse) FILTER (NOT failed), 0) AS good, max(ts) FILTER (failed) AS last_failure, max(ts) FILTER (NOT failed) AS last_success FROM p GROUP BY user_id),
f AS (SELECT g.*, (SELECT count(*) FROM p WHERE p.user_id = g.user_id AND failed AND pulse > good)::INT AS failures FROM g), a AS (SELECT *, failures < 2 OR n + 1 - bad >= {wait} AS available FROM f)
SELECT user_id, failures, available, CASE WHEN available THEN 0 ELSE {wait} END AS cooldown, last_failure, last_success FROM a""",
        "cycle_status": "WITH n AS (SELECT *, event_type = 'view' AS wish, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, coalesce(max(wish::INT) OVER (PARTITION BY user_id, n // 6 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS invocation_available, (6 - n % 6)::INT AS until_reset FROM n",
        "intrusions": f"WITH n AS (SELECT event_id, {names} AS ns FROM events) SELECT event_id, ns[({draw('event_id', 22)} % len(ns) + 1)::BIGINT] AS companion FROM n WHERE len(ns) > 0 AND ({draw('event_id', 21)} + 0.5::DOUBLE) / 281474976710656 < 0.12",
        "carry_notes": f"WITH n AS (SELECT doc_id, {duck.stripped(note)} AS note FROM documents) SELECT doc_id, CASE WHEN NOT contains(note, 'No carry note yet') AND length(note) >= 100 THEN md5(note) END AS digest FROM n",
        "dialog_texts": f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), b AS (SELECT conv_id, turn, {nl} || CASE WHEN role = 'assistant' THEN '**Assistant:**' ELSE '**' || upper(role) || ':**' END || {nl} || text || {nl} AS b FROM t WHERE i <= 6)
SELECT conv_id, md5({nl} || '### Companion dialog: c' || conv_id || CASE WHEN conv_id % 2 = 1 THEN ' (intruded)' ELSE ' (invoked)' END || {nl} || {nl} || '*2024-01-01 - ' || count(*) || ' turns*' || {nl} || {nl} || string_agg(b, {nl} ORDER BY turn)) AS digest FROM b GROUP BY conv_id""",
        "quick_summary": "SELECT user_id, (user_id % 9 + 1) || ' pulses, ' || count(*) FILTER (event_type <> 'view') || ' companion dialogs (' || coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type <> 'view')), ', '), 'none') || ')' AS summary FROM events GROUP BY user_id",
        "companion_activity": "SELECT event_id FROM events p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id = p.user_id AND e.ts >= p.ts)",
        "inbox_section": f"""WITH i AS (SELECT page_id % 40 AS box, 'item_' || page_id AS f, ((page_id // 3) % 4)::INT AS s FROM pages) SELECT box, md5('**Drops:**' || {nl} || 'Items waiting:' || {nl} || {nl} || string_agg('- `' || f || '` ' || CASE WHEN s = 0 THEN '(new)' ELSE '(considering)' END, {nl} ORDER BY f)) AS digest FROM i WHERE s < 2 GROUP BY box""",
        "tool_markers": f"SELECT doc_id, md5(regexp_replace(regexp_replace({markers}, '\\[Tool: ([^\\]]+)\\]', {nl} || '> *Using: \\1*' || {nl}, 'g'), '\\n{{3,}}', {nl} || {nl}, 'g')) AS digest FROM documents",
        "vocabulary_summary": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE {duck.stripped(f"substr('## Part I: Terms' || {nl} || text || CASE WHEN doc_id % 4 = 1 THEN '' ELSE {nl} || {nl} END, 1, CASE WHEN doc_id % 4 = 1 THEN 900 ELSE 1000000000 END)")} END AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 900 THEN substr(t, 1, 900) || {nl} || {nl} || '[...truncated for length]' ELSE t END) AS digest FROM t""",
        "session_ids": "SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') || '_' || substr(sha256(epoch_us(ts)::VARCHAR), 1, 8) AS session_id FROM events",
        "logs_in_range": "SELECT event_id, date_trunc('second', ts) AS at FROM events WHERE event_id % 9 > 0 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'",
    }
