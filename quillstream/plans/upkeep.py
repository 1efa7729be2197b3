"""Queries over the upkeep of notes: dated sections, due checks, marks, gates, states, context and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relate, upkeep
from ..sources.files import note_hash
from ..sources.tables import pick, table
from . import duck, memory

TITLE = "Standing Questions"
ENTRIES = [
    "**New (2024-01-05)** a", "*Updated 2024-02-30*, then (2024-02-11, b)", "none", "(2023-12-31) and Updated 2024-01-02\n**New (2024-03-09)**", "(2024-13-01)",
]
STATES = [
    '{"last_consolidation":"2024-01-03","consolidation_count":4}', '{"last_proposal":"2024-02-01","last_consolidation":"2023-01-01","proposal_count":7,"history":[1,2,3],"scan_count":2}', "{broken",
    '{"last_scan":"2024-01-09","processed_note_hashes":["a:1"],"applied_count":1,"last_applied":"2024-01-08"}',
]
ON = "2024-02-05 12:00:00"
KINDS = {"click": "scan", "signup": "proposal", "purchase": "applied"}
LIMITS = {"notes": 30, "tokens": 25000, "days": 9, "age": 40}


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a dated section (but every fifth) before another one."""
    head = F.when(F.pmod("doc_id", F.lit(5)) > 0, F.lit(f"## {TITLE}\n")).otherwise("## Else\n")
    text = F.concat("text", F.lit("\n"), head, pick(ENTRIES, F.col("doc_id")), F.lit("\n## Next\n(2020-01-01)"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def q_section_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = upkeep.section_dates(F.col("text"), TITLE)
    return dated(spark, sf_dir).select("doc_id", F.array_join(F.transform(dates, lambda d: d.cast("string")), ",").alias("dates"), F.datediff(F.lit("2024-04-01").cast("date"), F.get(dates, F.lit(0))).alias("oldest"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source what is due: notes not seen, tokens, days since an applied step, days of the oldest date."""
    found = memory.files(spark, sf_dir).groupBy("source").agg(
        F.count(F.when(F.pmod("doc_id", F.lit(4)) > 0, 1)).alias("new_notes"), F.sum("tokens").alias("tokens"), F.max(F.when(F.pmod("doc_id", F.lit(97)) == 5, F.col("date"))).alias("applied"),
        F.min("date").alias("first"),
    )
    on = F.lit(ON).cast("timestamp")
    return found.withColumn("days", upkeep.days_since(F.to_timestamp("applied"), on)).withColumn("oldest", F.datediff(on, F.to_date("first")))


def q_due_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = upkeep.due(facts(spark, sf_dir), LIMITS["notes"], LIMITS["tokens"], LIMITS["days"], LIMITS["age"])
    return found.select("source", "scan", "scan_reasons", "proposal", "proposal_reasons")


def q_proposal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    status = events.groupBy("user_id").agg((F.count(F.when(F.col("event_type") == "error", 1)) > 1).alias("proposal"))
    proposals = events.where("event_type = 'signup'").select("user_id", "ts")
    return upkeep.gated(status, proposals, "user_id", "ts", F.lit("2024-01-31").cast("timestamp"), 5).select("user_id", "decision")


def q_latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("name"))
    best = upkeep.latest(files, ["user_id"], "ts", "name", 3)
    return best.select("user_id", "name", F.col("place").cast("int"), note_hash(F.col("name").cast("string"), F.col("ts")).alias("hash"))


def q_name_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.pmod("event_id", F.lit(9)) > 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_note.md"))).otherwise("2024-02-31_x.md")
    return table(spark, sf_dir, "events").select("event_id", upkeep.name_age(name, F.lit("2024-02-01").cast("date")).alias("days"))


def q_trigger_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    events = table(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind"), F.col("event_id").cast("string").alias("trigger")).where("kind IS NOT NULL")
    return upkeep.marks(events, "user_id", "kind", "ts", "trigger")


def q_state_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", upkeep.migrated_state(pick(STATES, F.col("event_id"))).alias("s"))
    return rows.select("event_id", "s.*")


#: Tokens of the notes that one text may take in, and what is kept in reserve; a note counts one more than its tokens.
CONTEXT, RESERVE = 32000, 1000


def taken(files: DataFrame) -> DataFrame:
    """The first notes of each source that fit into a context."""
    return relate.packed(files.withColumn("_cost", F.col("tokens") + 1), "source", [F.col("doc_id")], "_cost", CONTEXT, RESERVE).drop("_cost", "used")


def bodied(files: DataFrame) -> DataFrame:
    """Note files with what a text says of each: name, age and first line."""
    body = F.concat(F.lit("### "), "path", F.lit(" "), upkeep.age_label(F.pmod("doc_id", F.lit(3)).cast("int")), F.lit("\n\n"), "first_line")
    return files.withColumn("body", body)


def totals(files: DataFrame) -> DataFrame:
    return files.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the notes that fit, with their age, and how many there are in all."""
    files = memory.files(spark, sf_dir)
    grouped = bodied(taken(files)).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "body"))).alias("_b"))
    return totals(files).join(grouped, "source", "left")


def q_context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each source's context with all its notes, whose pieces stream past the hash in order."""
    files, rule, none = bodied(memory.files(spark, sf_dir)), "\n\n---\n\n", F.lit(None).cast("long")
    texts = table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("archived"), F.count("*").alias("n"), F.count("text").alias("told")).where("source IS NOT NULL")
    document, archived = F.concat(F.lit("about "), "source"), upkeep.shortened(F.col("archived"))
    frame = lambda place, between, text: F.struct(F.lit(place).alias("place"), F.lit(between).alias("between"), text.alias("text"))
    frames = F.array(
        frame(0, "", F.when(F.col("n") > 18, F.concat(F.lit("## Current document\n\n"), document))), frame(1, rule, F.lit("## Recent notes")),
        frame(2, "\n\n", F.when(F.col("told") == 0, "(No notes found)")), frame(3, rule, F.when(archived != "", F.concat(F.lit("## Recently archived (for reference)\n\n"), archived))),
    )
    ends = texts.select("source", F.explode(frames).alias("_f")).select("source", "_f.*", none.alias("doc_id"))
    pieces = files.where("source IS NOT NULL").select("source", F.lit(2).alias("place"), F.lit("\n\n").alias("between"), F.col("body").alias("text"), "doc_id")
    found = upkeep.digests(ends.unionByName(pieces), "source", ["place", "doc_id"], "text", "between")
    return found.select("source", "digest", F.col("chars").cast("int"))


def q_note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = memory.files(spark, sf_dir).select("source", "doc_id", upkeep.note_line().alias("line"), F.lit("\n").alias("between"))
    return upkeep.digests(lines, "source", ["doc_id"], "line", "between").select("source", "digest")


def q_proposal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lambda n: F.slice(F.transform("_b", lambda b: b["body"]), 1, n)
    none = F.array().cast("array<string>")
    text = upkeep.proposal_text("Proposal", F.col("n"), F.col("tokens"), {"INTEGRATE": items(2), "ARCHIVE": F.when(F.col("n") > 19, items(1)).otherwise(none), "STALE": none})
    return listed(spark, sf_dir).select("source", F.md5(text).alias("digest"))


def oracles() -> dict[str, str]:
    nl = "chr(10)"
    choose = lambda values, index: f"({duck.array(values)})[(({index}) % {len(values)} + 1)::BIGINT]"
    entry = choose(ENTRIES, "doc_id")
    files = memory.oracles()["notes_scan"].split("WITH ")[1].split(" SELECT path, date")[0]
    when = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items())
    get = lambda f: f"CASE WHEN json_valid(s) THEN json_extract_string(s, '$.{f}') END"
    size = lambda f: f"coalesce(CASE WHEN json_valid(s) THEN json_array_length(s, '$.{f}') END, 0)::INT"
    fits = f"fits AS (SELECT * FROM (SELECT *, sum(tokens + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM files) WHERE used < {CONTEXT - RESERVE})"
    bodied = lambda rows: f"""b AS (SELECT source, doc_id, '### ' || path || CASE WHEN doc_id % 3 > 0 THEN ' (' || (doc_id % 3) || ' days old)' ELSE ' (today)' END || {nl} || {nl} || first_line AS body FROM {rows}),
a AS (SELECT source, arg_min(text, doc_id) AS archived FROM documents GROUP BY source), g AS (SELECT source, n, tokens, bs FROM (SELECT source, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM files GROUP BY source) LEFT JOIN (SELECT source, list(body ORDER BY doc_id) AS bs FROM b GROUP BY source) USING (source))"""  # noqa: E731
    bodies = f"{files}, {fits}, {bodied('fits')}"
    rule = f"{nl} || {nl} || '---' || {nl} || {nl}"
    return {
        "section_dates": f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN {entry} ELSE '' END AS s FROM documents),
d AS (SELECT doc_id, list_sort(list_filter(list_transform(list_concat(list_concat(regexp_extract_all(s, '\\((\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), regexp_extract_all(s, 'Updated (\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)), regexp_extract_all(s, '\\*\\*New \\((\\d{{4}}-\\d{{2}}-\\d{{2}})\\)', 1)), lambda x: try_cast(x AS DATE)), lambda x: x IS NOT NULL)) AS ds FROM t)
SELECT doc_id, coalesce(array_to_string(ds, ','), '') AS dates, date_diff('day', ds[1], DATE '2024-04-01')::INT AS oldest FROM d""",
        "due_checks": f"""WITH {files}, f AS (SELECT source, count(*) FILTER (doc_id % 4 > 0) AS n, sum(tokens)::BIGINT AS t, max(CASE WHEN doc_id % 97 = 5 THEN date END) AS applied, min(date) AS first FROM files GROUP BY source),
g AS (SELECT *, coalesce((epoch_us(TIMESTAMP '{ON}') - epoch_us(applied::TIMESTAMP)) // 86400000000, 999)::INT AS days, date_diff('day', first::DATE, DATE '{ON[:10]}') AS oldest FROM f),
r AS (SELECT source, concat_ws('; ', CASE WHEN n >= {LIMITS['notes']} THEN 'new_notes: ' || n || ' unprocessed notes' END, CASE WHEN t >= {LIMITS['tokens']} THEN 'document_size: ~' || t || ' tokens (threshold: {LIMITS['tokens']})' END) AS scan_reasons,
concat_ws('; ', CASE WHEN days >= 999 THEN 'days_since_applied: never applied' WHEN days >= {LIMITS['days']} THEN 'days_since_applied: ' || days || ' days' END, CASE WHEN oldest >= {LIMITS['age']} THEN 'section_age: oldest entry is ' || oldest || ' days old' END) AS proposal_reasons FROM g)
SELECT source, scan_reasons <> '' AS scan, scan_reasons, proposal_reasons <> '' AS proposal, proposal_reasons FROM r""",
        "proposal_gate": """WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') > 1 AS proposal, max(ts) FILTER (event_type = 'signup') AS last FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN coalesce((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) // 86400000000 < 5, false) THEN 'skipped' WHEN proposal THEN 'run' ELSE 'not due' END AS decision FROM s""",
        "latest_files": "WITH r AS (SELECT user_id, event_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS place, event_id || ':' || (epoch_us(ts) // 1000000) AS hash FROM events) SELECT * FROM r WHERE place <= 3",
        "name_ages": "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN date_diff('day', ts::DATE, DATE '2024-02-01') ELSE 0 END::INT AS days FROM events",
        "trigger_marks": f"""WITH k AS (SELECT user_id, ts, event_id, CASE event_type {when} END AS kind FROM events)
SELECT user_id, max(ts) FILTER (kind IN ('scan', 'applied')) AS last_scan, count(*) FILTER (kind IN ('scan', 'applied')) AS scan_count, max(ts) FILTER (kind = 'proposal') AS last_proposal, count(*) FILTER (kind = 'proposal') AS proposal_count,
max(ts) FILTER (kind = 'applied') AS last_applied, count(*) FILTER (kind = 'applied') AS applied_count, coalesce(string_agg(kind || ':' || event_id, ',' ORDER BY ts, kind || ':' || event_id) FILTER (kind <> 'scan'), '') AS history FROM k WHERE kind IS NOT NULL GROUP BY user_id""",
        "state_migration": f"""WITH t AS (SELECT event_id, {choose(STATES, 'event_id')} AS s FROM events) SELECT event_id, {get('last_scan')} AS last_scan, coalesce({get('last_proposal')}, {get('last_consolidation')}) AS last_proposal, {get('last_applied')} AS last_applied,
coalesce(({get('scan_count')})::BIGINT, 0) AS scan_count, coalesce(({get('proposal_count')})::BIGINT, ({get('consolidation_count')})::BIGINT, 0) AS proposal_count, coalesce(({get('applied_count')})::BIGINT, 0) AS applied_count, {size('history')} AS history, {size('processed_note_hashes')} AS processed_note_hashes FROM t""",
        "context_assembly": f"""WITH {files}, {bodied('files')}, c AS (SELECT source, concat_ws({rule}, CASE WHEN n > 18 THEN '## Current document' || {nl} || {nl} || 'about ' || source END, '## Recent notes' || {nl} || {nl} || coalesce(array_to_string(bs, {nl} || {nl}), '(No notes found)'),
'## Recently archived (for reference)' || {nl} || {nl} || CASE WHEN length(archived) > 500 THEN substr(archived, 1, 500) || {nl} || {nl} || '[... truncated ...]' ELSE archived END) AS context FROM g JOIN a USING (source)) SELECT source, md5(context) AS digest, length(context)::INT AS chars FROM c""",
        "note_lines": f"WITH {files}, l AS (SELECT source, doc_id, '- **' || path || '** (' || coalesce(date, 'unknown') || ', ' || lines || ' lines)' || {nl} || '  First line: ' || substr(first_line, 1, 80) || '...' AS v FROM files) SELECT source, md5(string_agg(v, {nl} ORDER BY doc_id)) AS digest FROM l GROUP BY source",
        "proposal_text": f"""WITH {bodies} SELECT source, md5(concat_ws({rule}, '# Proposal' || {nl} || {nl} || 'Notes reviewed: ' || n || {nl} || 'Total context tokens (estimated): ' || tokens, '## INTEGRATE' || {nl} || {nl} || coalesce(array_to_string(bs[1:2], {nl} || {nl}), '(Nothing flagged)'),
'## ARCHIVE' || {nl} || {nl} || CASE WHEN n > 19 AND bs IS NOT NULL THEN bs[1] ELSE '(Nothing flagged)' END, '## STALE' || {nl} || {nl} || '(Nothing flagged)')) AS digest FROM g""",
    }
