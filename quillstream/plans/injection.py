"""Queries over the texts that tell a run about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, injection, retrieval, signals, temporal
from ..sources.tables import notes, pick, table
from . import duck
from . import signals as sig

LABELS = ["frustrated", "anxious", "bored", "depleted", "curious", "content", "excited", "neutral", "engaged_critical", "unheard"]
QUERIES = {"warm": ["shared recognition", "talk among friends"], "curious": ["new ground", "what if", "unknown terms"], "bored": ["other work"]}
ROOT = "/srv/project"
PARTS = [
    "Alex left specific instructions for this run:\ndo this\nand that  \n---\n", "Stylistic residue of today:\n\n  soft edges \n---\nother\n", "Interoceptive signal (x):\n- a: 1\n", "static text\n---\n",
    "Feeling state: warm\nlight\n---\nrest\n", "Pending consolidation since then\nproposal_1\n---\n", "Prediction error follows\nz 2.1",
]


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with observed and predicted type and three signals with their deviations."""
    df = sig.typed(signals.with_linguistic(notes(spark, sf_dir)))
    kinds = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("observed")).otherwise("exploratory")
    return temporal.baseline_scores(df, "source", "doc_id", "observed", sig.Z).withColumn("predicted", kinds)


def q_prediction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predicted(spark, sf_dir)
    text = injection.prediction_error(F.col("predicted"), F.col("observed"), {z: (F.col(z), F.col(f"z_{z}")) for z in sig.Z})
    return df.select("doc_id", injection.any_deviation([F.col(f"z_{z}") for z in sig.Z]).alias("deviates"), F.md5(text).alias("digest"))


def moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a feeling, its confidence and duration, and levels of three drives."""
    level = lambda n: F.round(F.pmod(F.abs("value") * n, F.lit(100)) / 100, 3)
    return table(spark, sf_dir, "events").select(
        "event_id", pick(LABELS, F.col("event_id")).alias("feeling"), (F.pmod("event_id", F.lit(7)) / 7).alias("confidence"), F.pmod("user_id", F.lit(5)).cast("int").alias("pulses"),
        level(1).alias("building"), level(3).alias("publishing"), level(7).alias("experimenting"), F.pmod("event_id", F.lit(4)).cast("int").alias("since"),
    )


def told_drives() -> Column:
    return injection.drive_text({d: F.col(d) for d in injection.DRIVES}, dict.fromkeys(injection.DRIVES, F.col("since")))


def q_self_empathy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = injection.self_empathy(F.col("feeling"), F.col("pulses"))
    return moods(spark, sf_dir).select("event_id", F.array_join(injection.lenses(F.col("feeling")), "+").alias("lenses"), classify.affordances(F.col("feeling")).alias("affordances"), F.md5(text).alias("digest"))


def q_drive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moods(spark, sf_dir).select("event_id", F.md5(told_drives()).alias("digest"))


def q_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.pmod("event_id", F.lit(3)) == 0, "Interoceptive signal: x")
    text = injection.injection(error, F.col("feeling"), F.col("confidence"), F.col("pulses"), told_drives())
    return moods(spark, sf_dir).select("event_id", F.md5(text).alias("digest"))


def q_dynamic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda k: pick(PARTS, F.col("doc_id") * k + F.lit(k))
    prompt = F.concat(F.lit("# Static\n"), step(1), F.substring("text", 1, 1 << 20), F.lit("\n---\n"), step(2), step(3), step(5))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(injection.dynamic_sections(prompt, "Alex")).alias("digest"))


def q_standalone_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" PER-"), (F.pmod("doc_id", F.lit(90)) + 10).cast("string"), F.lit(" and AB-7, AB-7"))
    feelings = notes(spark, sf_dir).groupBy("source").agg(F.max_by(pick(["warm", "curious", "neutral"], F.col("doc_id")), "doc_id").alias("feeling"))
    messages = notes(spark, sf_dir).withColumn("text", text).join(feelings, "source")
    return injection.standalone_plan(messages, "doc_id", retrieval.issue_refs(F.col("text")), retrieval.file_refs(F.col("text")), F.col("feeling"), QUERIES, 5)


def q_pointer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").withColumn("query", F.substring(retrieval.sanitised(F.col("text")), 1, 90)).withColumn("count", F.pmod("doc_id", F.lit(4)) + 1)
    path = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit(f"{ROOT}/notes/"), "source", F.lit(".md"))).otherwise(F.concat(F.lit("/other/place/"), "source"))
    line = injection.pointer_line(F.col("query"), injection.shortened_path(path, ROOT), F.col("count"), F.when(F.pmod("doc_id", F.lit(3)) > 0, retrieval.hint(F.col("text"))), F.when(F.pmod("doc_id", F.lit(5)) > 0, "category"))
    return df.select("doc_id", F.md5("query").alias("query"), F.md5(line).alias("line"))


def q_combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(4))
    answer = F.when(k == 0, F.concat(F.lit("Fine.\nSCORE:  "), F.round(F.abs("value"), 2).cast("string"), F.lit("/10"))).when(k == 1, "SCORE: none").when(k == 2, F.concat(F.lit("SCORE: "), F.pmod("event_id", F.lit(9)).cast("string")))
    given = injection.rated(answer)
    own = F.pmod("event_id", F.lit(50)) / 4
    return table(spark, sf_dir, "events").select("event_id", given.alias("given"), F.round(injection.combined_score(own, given), 6).alias("combined"))


def oracles() -> dict[str, str]:
    nl = "chr(10)"
    choose = lambda values, index: f"({duck.array(values)})[(({index}) % {len(values)} + 1)::BIGINT]"
    text = lambda s: " || chr(10) || ".join(duck.lit(x) for x in s.split("\n"))
    level = lambda n: f"round(((abs(value) * {n}) % 100) / 100, 3)"
    mood = f"m AS (SELECT event_id, {choose(LABELS, 'event_id')} AS feeling, (event_id % 7) / 7::DOUBLE AS confidence, (user_id % 5)::INT AS pulses, {level(1)} AS building, {level(3)} AS publishing, {level(7)} AS experimenting, (event_id % 4)::INT AS since FROM events)"
    lens = "CASE feeling " + " ".join(f"WHEN '{f}' THEN {duck.array(ls) if ls else '[]::VARCHAR[]'}" for f, ls in injection.LENSES.items()) + " END"
    offered = "CASE feeling " + " ".join(f"WHEN '{f}' THEN {duck.lit(', '.join(a).replace('_', ' '))}" for f, a in classify.AFFORDANCES.items()) + " ELSE '' END"
    checks = "- CBT lens: What thought pattern is active? Check for:\n" + "\n".join(f"  - {n}: {t}" for n, t in injection.DISTORTIONS.items())
    empathy = f"""CASE WHEN len({lens}) > 0 THEN concat_ws({nl}, 'Self-empathy check (' || feeling || ' for ' || pulses || ' pulses):', CASE WHEN list_contains({lens}, 'cbt') THEN {text(checks)} END,
CASE WHEN list_contains({lens}, 'pct') THEN '- PCT lens: What''s the honest felt-sense, without performance?' END, CASE WHEN list_contains({lens}, 'rt') THEN '- RT lens: What''s the specific obstacle? What action would help?' END, '', 'You may address this directly or let it inform your work.') END"""
    want = {"building": "' — no code changes in ' || since || ' pulses'", "publishing": "' — good written material accumulating without outlet'", "experimenting": "' — curiosity high but channeling into reflection, not experiment'"}
    drive = ", ".join(f"CASE WHEN {n} >= {t} THEN '- {d}: ' || format('{{:.2f}}', floor({n} * 100 + 0.500000001) / 100) || ' (' || CASE WHEN {n} < 0.8 THEN 'elevated' ELSE 'strong' END || CASE WHEN since > 0 THEN {want[n]} ELSE '' END || ')' END" for n, (d, t) in injection.DRIVES.items())
    told = f"CASE WHEN greatest(building / 0.6::DOUBLE, publishing / 0.5::DOUBLE, experimenting / 0.55::DOUBLE) >= 1 THEN 'Drive states:' || {nl} || concat_ws({nl}, {drive}) || {nl} || {nl} || 'These are internal pressures, not instructions. Notice them or don''t.' END"
    lasting = "(confidence >= 0.5 AND pulses >= 2 AND feeling <> 'neutral')"
    part = lambda k: choose(PARTS, f"doc_id * {k} + {k}")
    opens = ["Alex left specific instructions.*?:", *injection.SECTIONS.values()]
    found = ", ".join(f"nullif({duck.stripped(f'''regexp_extract(p, {duck.lit('(?s)' + o + chr(92) + 'n(.+?)(?:' + chr(92) + 'n---|' + chr(92) + 'z)')}, 1)''')}, '')" for o in opens)
    line = lambda z: f"'- {z}: ' || {z} || CASE WHEN coalesce(abs(z_{z}) > 1.5, false) THEN ' (' || CASE WHEN z_{z} > 0 THEN '+' ELSE '-' END || format('{{:.1f}}', floor(abs(z_{z}) * 10 + 0.500000001) / 10) || ' std vs ' || observed || ' baseline)' ELSE ' (within expected)' END"
    refs = "regexp_extract_all(text, '\\b([A-Z]{2,5}-\\d+)\\b', 1)", "regexp_extract_all(text, '\\b([\\w/-]+\\.(?:py|md|json|yaml|ts))\\b', 1)"
    named = lambda xs, o: f"list_transform({xs}, lambda q: {{q: q, o: {o}}})"
    asked = "CASE feeling " + " ".join(f"WHEN '{f}' THEN {duck.array(q)}" for f, q in QUERIES.items()) + " ELSE [] END"
    clean = "trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    hint = "CASE WHEN length(line) <= 100 THEN line ELSE regexp_replace(substr(line, 1, 100), '\\s+\\S*$', '') END"
    lines = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 10 AND NOT starts_with(x, '#') AND NOT starts_with(x, '---'))[1]"
    given = "CASE event_id % 4 WHEN 0 THEN round(abs(value), 2) WHEN 2 THEN (event_id % 9)::DOUBLE END"
    return {
        "prediction_error": f"""WITH {sig.baseline_sql('source')}, pr AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN observed ELSE 'exploratory' END AS predicted FROM zs),
dv AS (SELECT *, {' OR '.join(f'coalesce(abs(z_{z}) > 1.5, false)' for z in sig.Z)} AS deviates FROM pr)
SELECT doc_id, deviates, CASE WHEN deviates OR predicted <> observed THEN md5(concat_ws({nl}, CASE WHEN predicted = observed THEN 'Interoceptive signal (' || observed || ' context, confirmed):' ELSE 'Interoceptive signal (predicted: ' || predicted || ', observed: ' || observed || '):' END, {', '.join(line(z) for z in sig.Z)})) END AS digest FROM dv""",
        "self_empathy": f"WITH {mood} SELECT event_id, array_to_string({lens}, '+') AS lenses, {offered} AS affordances, md5({empathy}) AS digest FROM m",
        "drive_text": f"WITH {mood} SELECT event_id, md5({told}) AS digest FROM m",
        "injection": f"""WITH {mood} SELECT event_id, md5(nullif(concat_ws({nl}, CASE WHEN event_id % 3 = 0 THEN 'Interoceptive signal: x' END, CASE WHEN {lasting} THEN {nl} || 'Feeling state: ' || feeling || ' (' || pulses || ' pulses)' END,
CASE WHEN {lasting} AND {offered} <> '' THEN 'Affordances available: ' || {offered} END, CASE WHEN {lasting} THEN {nl} || {empathy} END, {nl} || {told}), '')) AS digest FROM m""",
        "dynamic_sections": f"WITH t AS (SELECT doc_id, '# Static' || {nl} || {part(1)} || text || {nl} || '---' || {nl} || {part(2)} || {part(3)} || {part(5)} AS p FROM documents) SELECT doc_id, md5(concat_ws({nl}, {found})) AS digest FROM t",
        "standalone_plan": f"""WITH {duck.NOTES}, f AS (SELECT source, arg_max({choose(['warm', 'curious', 'neutral'], 'doc_id')}, doc_id) AS feeling FROM notes GROUP BY source), t AS (SELECT doc_id, feeling, text || ' PER-' || (doc_id % 90 + 10) || ' and AB-7, AB-7' AS text FROM notes JOIN f USING (source)),
l AS (SELECT doc_id, list_concat(list_concat({named(f'list_sort(list_distinct({refs[0]}))', "'issue-ref'")}, {named(f'list_sort(list_distinct({refs[1]}))', "'file-ref'")}), {named(asked, "'feeling: ' || feeling")})[1:5] AS qs FROM t), u AS (SELECT doc_id, unnest(qs) AS q, generate_subscripts(qs, 1)::INT AS place FROM l)
SELECT doc_id, place, q.q AS query, q.o AS origin FROM u""",
        "pointer_lines": f"""WITH t AS (SELECT doc_id, source, substr({clean}, 1, 90) AS query, {lines} AS line, (doc_id % 4 + 1) AS n FROM documents), h AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN {hint} END AS hint FROM t)
SELECT doc_id, md5(query) AS query, md5('- `"' || CASE WHEN length(query) > 80 THEN substr(query, 1, 80) || '...' ELSE query END || '"` → `' || CASE WHEN doc_id % 2 = 0 THEN 'notes/' || source || '.md' ELSE source END || '`' || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ' more)' ELSE '' END
|| CASE WHEN coalesce(hint, '') <> '' THEN {nl} || '  *' || hint || '*' ELSE '' END || CASE WHEN doc_id % 5 > 0 THEN ' [category]' ELSE '' END) AS line FROM h""",
        "combined_scores": f"WITH g AS (SELECT event_id, (event_id % 50) / 4::DOUBLE AS own, {given} AS given FROM events) SELECT event_id, given, round(CASE WHEN given IS NOT NULL THEN (own + given) / 2 ELSE own END, 6) AS combined FROM g",
    }
