"""Queries over signals of notes, and over the same signals in the order of each language's notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import classify, signals, temporal
from ..sources.tables import lexicon, notes, pick, table
from . import duck

Z = ["hedging_ratio", "self_correction", "question_density"]
B = signals.BEHAVIOURS


def q_signals_linguistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.with_linguistic(notes(spark, sf_dir))
    return found.select("doc_id", "meta_commentary", "hedging_ratio", "self_correction", "question_density")


def q_signals_affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.with_affect(notes(spark, sf_dir), lexicon(spark), "doc_id")
    return found.select("doc_id", "affect_valence", "affect_arousal")


def q_signals_behavioral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.with_behaviours(notes(spark, sf_dir)).select("doc_id", *[f"behavioral_{b}" for b in B])


def typed(df: DataFrame) -> DataFrame:
    dialog = F.pmod(F.col("doc_id"), F.lit(17)) == 0
    return classify.with_output_type(df, "text", dialog, "o").withColumn("observed", F.col("o.type"))


def q_output_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(notes(spark, sf_dir)).select("doc_id", "observed", F.col("o.confidence").alias("confidence"))


def felt(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = signals.with_affect(signals.with_behaviours(typed(notes(spark, sf_dir))), lexicon(spark), "doc_id").drop("text")
    scores = {b: F.col(f"behavioral_{b}") for b in B}
    return classify.with_feeling(full, "affect_valence", "affect_arousal", F.col("observed"), scores, "f")


def q_feeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return felt(spark, sf_dir).select(
        "doc_id",
        F.col("f.type").alias("feeling"),
        F.round("f.confidence", 3).alias("confidence"),
        F.round(F.round((F.abs("affect_valence") + F.col("affect_arousal")) / 2, 9), 3).alias("intensity"),
        classify.affordances(F.col("f.type")).alias("affordances"),
    )


def q_predicted_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda n, k: F.pmod(F.col("doc_id"), F.lit(n)) == k
    given = [F.when(m(n, k), F.col("text")) for n, k in ((3, 0), (3, 1), (2, 1))]
    df = classify.with_hints(typed(notes(spark, sf_dir)), *given)  # all that needs the text comes first, so that no text is sorted or joined
    df = df.select("doc_id", "source", "observed", *[c for c in df.columns if c.startswith(("_i_", "_r_", "_hinted"))])
    df = temporal.with_last_observed(df, "source", "doc_id", "observed", "last_type")
    expected = classify.expected_type(m(23, 5), m(7, 2), F.pmod(F.col("doc_id"), F.lit(8)) + 1, F.col("last_type"))
    return df.withColumn("e", expected).select("doc_id", F.col("e.type").alias("expected"), F.col("e.confidence").alias("confidence"))


def linguistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.with_linguistic(notes(spark, sf_dir)).select("doc_id", "source", "meta_commentary", *Z)


def q_decayed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.decayed_peaks(linguistic(spark, sf_dir), "source", "doc_id", {"meta_commentary": 0.0, "hedging_ratio": 0.5, "question_density": 0.0})


def q_decayed_peaks_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = temporal.decayed_peaks_closed(linguistic(spark, sf_dir).select("doc_id", "source", "question_density"), "source", "doc_id", "question_density")
    return found.select("doc_id", F.round(F.round("peak", 9), 6).alias("peak"))


def q_elevation_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.elevation(linguistic(spark, sf_dir).select("doc_id", "source", "hedging_ratio"), "source", "doc_id", "hedging_ratio").select("doc_id", "elevated", F.col("streak").cast("long"))


def q_baseline_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = typed(signals.with_linguistic(notes(spark, sf_dir))).select("doc_id", "source", "observed", *Z)
    found = temporal.baseline_scores(df, "source", "doc_id", "observed", Z)
    return found.select("doc_id", "observed", *[f"z_{z}" for z in Z])


def q_baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines by type and signal; a type that the table does not know reads the exploratory ones."""
    seeds = [(kind, name, *row, temporal.SEED_COUNT) for kind, rows in temporal.SEEDS.items() for name, row in zip(temporal.SIGNALS, rows, strict=True)]
    known = spark.createDataFrame(seeds, "type string, signal string, mean double, std double, count int")
    rows = table(spark, sf_dir, "events").select("event_id", pick(["companion", "consolidation", "unheard"], F.col("event_id")).alias("kind"), pick(["hedging_ratio", "question_density", "none"], F.floor(F.col("event_id") / 3)).alias("signal"))
    return temporal.with_baseline(rows, known, "kind", "signal")


def q_feeling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = felt(spark, sf_dir).select("doc_id", "source", F.col("f.type").alias("label"))
    return temporal.feeling_runs(df, "source", "doc_id", "label").select("doc_id", "label", F.col("in_state").cast("long"), "previous")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as pulses: what was done follows from the type of the event."""
    is_type = lambda t: F.col("event_type") == t
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", is_type("purchase").alias("code_changed"), is_type("click").alias("notes_written"),
        is_type("signup").alias("publishable"), is_type("error").alias("research"), (F.col("value") > 50).alias("reflective"),
    )


def q_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.drives(pulses(spark, sf_dir), "user_id", "event_id")


def linguistic_sql() -> str:
    n = f"greatest(1, len({duck.sentences('text')}))"
    return f"""{duck.NOTES}, lc AS (SELECT *, {n} AS n, {duck.matches('text', L.HEDGE_PATTERNS)} AS h, {duck.matches('text', L.ASSERT_PATTERNS)} AS a,
  {duck.matches('text', L.META_PATTERNS)} AS m, {duck.matches('text', L.CORRECTION_PATTERNS)} AS c,
  regexp_replace(regexp_replace(text, '"[^"]*"', '', 'g'), '(^|[^\\w])''[^'']*''($|[^\\w])', '\\1\\2', 'g') AS unquoted FROM notes),
ling AS (SELECT doc_id, source, text, {duck.r3('least(1.0, m / n)')} AS meta_commentary, {duck.r3('coalesce(h / nullif(h + a, 0), 0.5)')} AS hedging_ratio, c::DOUBLE AS self_correction,
  {duck.r3("least(1.0, (length(unquoted) - length(replace(unquoted, '?', ''))) / n)")} AS question_density FROM lc)"""


def type_sql(source: str) -> str:
    k = classify
    return f"""ty AS (SELECT *, {duck.matches('text', k.TOOL_PATTERNS)} AS ti, {duck.matches('text', k.PHILOSOPHICAL_PATTERNS)} AS tp, {duck.matches('text', k.CONSOLIDATION_PATTERNS)} AS tc, {duck.matches('text', k.COMPANION_PATTERNS)} AS td FROM {source}),
tr AS (SELECT *, greatest(ti, tp, tc) AS top, list_reverse_sort([ti, tp, tc])[2] AS second FROM ty),
typed AS (SELECT *, CASE WHEN text = '' THEN 'exploratory' WHEN doc_id % 17 = 0 OR td >= 3 THEN 'companion' WHEN top < 2 OR top < 2 * greatest(second, 1) THEN 'exploratory' WHEN ti = top THEN 'infrastructure' WHEN tp = top THEN 'philosophical' ELSE 'consolidation' END AS observed,
  (CASE WHEN text = '' THEN 0.3 WHEN doc_id % 17 = 0 THEN 0.9 WHEN td >= 3 THEN 0.6 WHEN top < 2 OR top < 2 * greatest(second, 1) THEN 0.3 WHEN top >= 4 THEN 0.6 ELSE 0.3 END)::DOUBLE AS confidence FROM tr)"""


def affect_sql(source: str) -> str:
    low = "lower(text)"
    negation = f"list_contains({duck.array(L.NEGATIONS)}, t)"
    return f"""{duck.WORDS}, tk AS (SELECT doc_id, {duck.words("regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s''-]', ' ', 'g')")} AS ws FROM {source}),
tu AS (SELECT doc_id, unnest(ws) AS t, unnest(list_transform(ws, lambda w, i: i > 1 AND list_contains({duck.array(L.NEGATIONS)}, ws[i - 1]))) AS neg FROM tk),
tm AS (SELECT doc_id, avg(CASE WHEN neg THEN -valence ELSE valence END) AS v, avg(arousal) AS r FROM tu JOIN lexicon ON t = word WHERE NOT {negation} GROUP BY doc_id),
tl AS (SELECT s.*, v, r, list_transform({duck.sentences('text')}, lambda s: len({duck.words('s')})) AS ls FROM {source} s LEFT JOIN tm USING (doc_id)),
ts AS (SELECT *, greatest(1, len(ls)) AS ln, CASE WHEN len(ls) >= 2 THEN sqrt(greatest(0, list_sum(list_transform(ls, lambda x: x * x)) / len(ls) - (list_sum(ls) / len(ls)) ** 2)) ELSE 0 END AS sd FROM tl),
aff AS (SELECT * EXCLUDE (v, r, ls, ln, sd), CASE WHEN {duck.stripped('text')} = '' THEN 0 ELSE {duck.r3(f"greatest(-1.0, least(1.0, coalesce(v, 0) - least(0.02 * {duck.occurrences(low, L.AFFECT_RESISTANCE)}, 0.08) + least(0.02 * ({duck.occurrences(low, L.AFFECT_PERMISSIONS)} + {duck.occurrences(low, L.LIFTS)}), 0.08)))")} END AS affect_valence,
  CASE WHEN {duck.stripped('text')} = '' THEN 0 ELSE {duck.r3("greatest(0.0, least(1.0, coalesce((r + 1) / 2, 0.5) + least(sd / 200, 0.05) + least((length(text) - length(replace(text, '!', ''))) / ln * 0.03, 0.06) + least((length(text) - length(replace(text, '?', ''))) / ln * 0.015, 0.03) + CASE WHEN len(ls) >= 3 AND len(list_filter(ls, lambda x: x < 5)) > 0 AND len(list_filter(ls, lambda x: x > 15)) > 0 THEN 0.03 ELSE 0 END))")} END AS affect_arousal FROM ts)"""


def behaviour_sql(source: str) -> str:
    h, m, s = duck.hits, duck.matches, duck.steps
    t, low = "text", "low"
    loops = " OR ".join(duck.found(t, p, "im") for p in L.LOOPS)
    unresolved = "(CASE WHEN length(st) > 100 THEN regexp_matches(st, '(\\?|\\.\\.\\.|--)$') OR contains(right(st, 100), 'I''m not sure') ELSE contains(st, 'I''m not sure') END)"
    caps = f"len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}') AND NOT list_contains({duck.array(L.ACRONYMS)}, w)))"
    scores = {
        "frustration": f"least(annoyed * 0.15, 0.3) + CASE WHEN varied AND terse > 0.2 THEN least(terse * 0.3, 0.2) ELSE 0 END + least({m(t, [chr(92) + 'b(?:' + '|'.join(L.EMOTIONAL_CAPS) + ')' + chr(92) + 'b'], '')} * 0.1, 0.2) + (({loops})::INT * 0.5 + ({h(low, L.MYTHS)} > 0)::INT * 0.5) * 0.2 + CASE WHEN repeated THEN 0.1 ELSE 0 END",
        "boredom": f"CASE WHEN {h(low, L.ENGAGEMENT)} >= 3 THEN 0 ELSE CASE WHEN {h(low, L.ENGAGEMENT)} >= 1 THEN -0.2 ELSE 0 END + CASE WHEN wc < 30 THEN 0.3 WHEN wc < 50 THEN 0.15 ELSE 0 END + CASE WHEN len(acts) = 0 THEN 0.1 ELSE 0 END + CASE WHEN {caps} = 0 THEN 0.05 ELSE 0 END + CASE WHEN varied THEN 0 ELSE 0.1 END + CASE WHEN ask = 0 THEN 0.1 ELSE 0 END + CASE WHEN {h(low, L.ROUTINE)} >= 2 THEN 0.2 ELSE 0 END END",
        "curiosity": f"least({duck.r3(f'least(1.0, {m(t, L.INTROSPECTION)} / pieces)')} * 2, 0.25) + {s(h(low, L.DELIGHT), (2, 0.2), (1, 0.1))} + {s(h(low, L.ELABORATION), (3, 0.25), (1, 0.15))} + CASE WHEN wc > 0 THEN {s('ask / (wc / 50)', (1, 0.15), (0.5, 0.08))} ELSE 0 END + {s(m(t, L.METAPHORS), (3, 0.1), (1, 0.05))} + CASE WHEN {unresolved} THEN 0.05 ELSE 0 END",
        "anxiety": f"{s(m(t, L.META_HEDGES), (2, 0.3), (1, 0.15))} + {s(h(low, L.POWERLESS), (2, 0.2), (1, 0.1))} + {s(h(low, L.PERMISSION_SEEKING), (2, 0.15), (1, 0.08))} + {s(m(t, L.CONTRADICTIONS), (2, 0.15), (1, 0.08))} + CASE WHEN {unresolved} THEN {s('ask', (4, 0.2), (2, 0.1))} ELSE 0 END",
        "joy": f"{s(m(t, L.JOY_ACTIONS), (2, 0.35), (1, 0.2))} + {s(m(t, L.REALIZATIONS), (2, 0.25), (1, 0.15))} + {s(h(low, L.UNDERSTATED), (2, 0.2), (1, 0.1))} + {s('bangs / pieces', (0.3, 0.2), (0.15, 0.1))}",
        "warmth": f"{s(m(t, L.INTIMATE), (3, 0.35), (2, 0.25), (1, 0.15))} + {s(h(low, L.TENDERNESS), (2, 0.35), (1, 0.2))} + {s(m(t, L.CALLBACKS), (2, 0.2), (1, 0.1))} + CASE WHEN wc > 0 AND {m(t, [chr(92) + 'byou' + chr(92) + 'b'])} / greatest(1, wc) > 0.02 THEN 0.1 ELSE 0 END",
        "arousal": f"{s('compressed', (3, 0.2), (1, 0.1))} + {s(m(t, L.ANAPHORA, 'is'), (2, 0.25), (1, 0.15))} + CASE WHEN {m(t, L.COLLISIONS)} >= 1 THEN 0.2 ELSE 0 END + {s(h(low, L.SUPERPOSITION), (2, 0.2), (1, 0.1))} + {s(h(low, L.INTENSITY), (3, 0.15), (1, 0.08))}",
    }
    each = ", ".join(f"CASE WHEN st = '' THEN 0 ELSE {duck.r3(f'greatest(0.0, least(1.0, {e}))')} END AS behavioral_{n}" for n, e in scores.items())
    return f"""b1 AS (SELECT *, lower(text) AS low, {duck.stripped('text')} AS st, list_transform({duck.sentences('text')}, lambda s: len({duck.words('s')})) AS ls, len({duck.words('text')}) AS wc,
  greatest(1, len(regexp_split_to_array(text, '[.!?]+'))) AS pieces, length(text) - length(replace(text, '?', '')) AS ask, length(text) - length(replace(text, '!', '')) AS bangs,
  regexp_extract_all(text, '(?i)\\*[a-z][a-z\\s]{{0,20}}\\*') AS acts,
  list_sort(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}'))) AS ws,
  len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {duck.stripped('x')}), lambda x: length(x) < 20 AND len({duck.words('x')}) <= 2 AND regexp_matches(x, {duck.lit(L.COMPRESSED_LINE)}))) AS compressed FROM {source}),
b2 AS (SELECT *, len(list_filter(acts, lambda a: regexp_matches(lower(a), {duck.lit('|'.join(L.FRUSTRATION_ACTIONS))}))) AS annoyed, coalesce({duck.r3('len(list_filter(ls, lambda x: x <= 3)) / nullif(len(ls), 0)')}, 0) AS terse,
  len(list_filter(ls, lambda x: x <= 3)) > 0 AND len(list_filter(ls, lambda x: x >= 10)) > 0 AS varied, len(list_filter(ws, lambda w, i: coalesce(ws[i + 3] = w, false))) > 0 AS repeated FROM b1),
beh AS (SELECT * EXCLUDE (low, st, ls, wc, pieces, ask, bangs, acts, ws, compressed, annoyed, terse, varied, repeated), {each} FROM b2)"""


def feeling_sql() -> str:
    v, a = "affect_valence", "affect_arousal"
    moves = [("frustration", 0.15, -0.15, 0.1), ("anxiety", 0.2, -0.1, 0.05), ("joy", 0.2, 0.15, 0.0), ("warmth", 0.2, 0.1, -0.05), ("curiosity", 0.2, 0.1, 0.1), ("arousal", 0.2, 0.0, 0.15), ("boredom", 0.2, -0.1, -0.1)]
    steps = f"n0 AS (SELECT *, {v} AS v0, {a} AS a0 FROM aff)"
    for i, (name, least, dv, da) in enumerate(moves):
        moved = f"least(1.0, a{i} + {da})" if da >= 0 else f"greatest(0.0, a{i} + {da})"
        on = f"behavioral_{name} >= {least}"
        steps += f", n{i + 1} AS (SELECT *, v{i} + CASE WHEN {on} THEN {dv}::DOUBLE ELSE 0 END AS v{i + 1}, CASE WHEN {on} THEN ({moved})::DOUBLE ELSE a{i} END AS a{i + 1} FROM n{i})"
    cases = [
        ("behavioral_frustration >= 0.3", "'frustrated'", "least(0.9, 0.5 + behavioral_frustration)"), ("behavioral_anxiety >= 0.35", "'anxious'", "least(0.85, 0.45 + behavioral_anxiety)"),
        ("behavioral_joy >= 0.4", "'delighted'", "least(0.9, 0.5 + behavioral_joy)"), ("behavioral_warmth >= 0.4", "CASE WHEN affect_arousal < 0.4 THEN 'peaceful' ELSE 'content' END", "least(0.85, 0.45 + behavioral_warmth)"),
        ("behavioral_curiosity >= 0.4", "CASE WHEN affect_arousal >= 0.6 OR behavioral_arousal >= 0.3 THEN 'excited' ELSE 'curious' END", "least(0.9, 0.5 + behavioral_curiosity)"),
        ("behavioral_arousal >= 0.4", "'excited'", "least(0.85, 0.45 + behavioral_arousal)"), ("behavioral_boredom >= 0.4", "'bored'", "least(0.8, 0.4 + behavioral_boredom)"),
        ("abs(v7) < 0.15 AND a7 < 0.4", "'neutral'", "0.8"), ("v7 <= -0.15 AND a7 >= 0.5 AND observed = 'infrastructure'", "'frustrated'", "0.7"), ("v7 <= -0.15 AND a7 >= 0.5 AND observed = 'philosophical'", "'engaged_critical'", "0.6"),
        ("v7 <= -0.15 AND a7 >= 0.5", "'anxious'", "0.5"), ("v7 <= -0.15 AND a7 < 0.3", "'bored'", "0.7"), ("v7 <= -0.15", "'depleted'", "0.6"), ("v7 >= 0.15 AND a7 >= 0.5", "CASE WHEN v7 > 0.3 THEN 'delighted' ELSE 'excited' END", "0.7"),
        ("v7 >= 0.15", "CASE WHEN a7 < 0.3 THEN 'peaceful' ELSE 'content' END", "0.7"), ("a7 >= 0.5", "CASE WHEN observed IN ('philosophical', 'exploratory') THEN 'curious' ELSE 'alert' END", "0.6"),
    ]
    label = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x, _ in cases) + " ELSE 'neutral' END"
    sure = "CASE " + " ".join(f"WHEN {c} THEN {y}" for c, _, y in cases) + " ELSE 0.5 END"
    return f"{duck.NOTES}, {type_sql('notes')}, {behaviour_sql('typed')}, {affect_sql('beh')}, {steps}, felt AS (SELECT doc_id, source, affect_valence, affect_arousal, {label} AS label, {duck.r3(sure)} AS sure FROM n7)"


def baseline_sql(key: str) -> str:
    """zs: signals of notes with their deviations from the running baseline of stream and type."""
    seeds = ", ".join(f"('{t}', '{s}', {rows[temporal.SIGNALS.index(s)][0]}::DOUBLE, {rows[temporal.SIGNALS.index(s)][1]}::DOUBLE)" for t, rows in temporal.SEEDS.items() for s in Z)
    stacked = " UNION ALL ".join(f"SELECT doc_id, {key}, observed, '{z}' AS s, {z} AS x FROM typed" for z in Z)
    return f"""{linguistic_sql()}, {type_sql('ling')}, seed(observed, s, m0, s0) AS (VALUES {seeds}), x AS ({stacked}),
r AS (SELECT x.*, m0, s0, count(*) OVER w AS n, coalesce(sum(x) OVER w, 0) AS t, coalesce(sum(x * x) OVER w, 0) AS q FROM x JOIN seed USING (observed, s) WINDOW w AS (PARTITION BY {key}, observed, s ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, (5 * m0 + t) / (5 + n) AS m FROM r), d AS (SELECT *, sqrt(greatest(0, 5 * s0 * s0 + q + 5 * m0 * m0 - (5 + n) * m * m) / (5 + n)) AS sd FROM b),
z AS (SELECT doc_id, observed, s, x, CASE WHEN sd < 0.001 THEN CASE WHEN abs(x - m) > 0.01 THEN 10 ELSE 0 END ELSE {duck.r3("(x - m) / sd", 2)} END AS z FROM d),
zs AS (SELECT doc_id, observed, {', '.join(f"max(x) FILTER (s = '{c}') AS {c}, max(z) FILTER (s = '{c}') AS z_{c}" for c in Z)} FROM z GROUP BY doc_id, observed)"""


def oracles() -> dict[str, str]:
    ling, k = linguistic_sql(), classify
    low = "lower(coalesce(ins, ''))"
    ctx, tex = "lower(coalesce(con, ''))", "lower(coalesce(tex, ''))"
    pick = lambda c, i, p, s, d: f"CASE greatest({', '.join(x for x in (i, p, s, d) if x)}) WHEN {i} THEN 'infrastructure' WHEN {p} THEN 'philosophical' WHEN {s} THEN 'consolidation' ELSE 'companion' END"
    afford = "CASE label " + " ".join(f"WHEN '{n}' THEN {duck.lit(', '.join(x).replace('_', ' '))}" for n, x in k.AFFORDANCES.items()) + " END"
    steps = [("meta_commentary", 0.0), ("hedging_ratio", 0.5), ("question_density", 0.0)]
    first = ", ".join(f"round(greatest({s}, {v}::DOUBLE * 0.85), 3) AS d_{s}" for s, v in steps)
    then = ", ".join(f"round(greatest(o.{s}, f.d_{s} * 0.85), 3)" for s, _ in steps)
    clamp = lambda x: f"round(greatest(0, least(1, {x})), 3)"
    drive = {
        "building": "CASE WHEN event_type = 'purchase' THEN -0.4 ELSE 0.15 END",
        "publishing": "CASE WHEN event_type = 'signup' THEN -0.35 WHEN event_type = 'click' THEN 0.05 ELSE 0.1 END",
        "experimenting": "CASE WHEN event_type = 'error' THEN -0.3 WHEN event_type = 'purchase' THEN -0.12 WHEN value > 50 THEN 0.08 ELSE -0.03 END",
    }
    known = ", ".join(f"('{kind}', '{name}', {m}::DOUBLE, {d}::DOUBLE)" for kind, rows in temporal.SEEDS.items() for name, (m, d) in zip(temporal.SIGNALS, rows, strict=True))
    return {
        "baseline_lookup": f"""WITH b(type, signal, mean, std) AS (VALUES {known}), e AS (SELECT event_id, (['companion', 'consolidation', 'unheard'])[(event_id % 3 + 1)::BIGINT] AS kind, (['hedging_ratio', 'question_density', 'none'])[((event_id // 3) % 3 + 1)::BIGINT] AS signal FROM events)
SELECT event_id, kind, e.signal, mean, std, CASE WHEN mean IS NOT NULL THEN 5 END::INT AS count FROM e LEFT JOIN b ON b.signal = e.signal AND b.type = CASE WHEN kind = 'unheard' THEN 'exploratory' ELSE kind END""",
        "signals_linguistic": f"WITH {ling} SELECT doc_id, meta_commentary, hedging_ratio, self_correction, question_density FROM ling",
        "signals_affect": f"WITH {duck.NOTES}, {affect_sql('notes')} SELECT doc_id, affect_valence, affect_arousal FROM aff",
        "signals_behavioral": f"WITH {duck.NOTES}, {behaviour_sql('notes')} SELECT doc_id, {', '.join(f'behavioral_{b}' for b in B)} FROM beh",
        "output_type": f"WITH {duck.NOTES}, {type_sql('notes')} SELECT doc_id, observed, confidence FROM typed",
        "feeling": f"WITH {feeling_sql()} SELECT doc_id, label AS feeling, sure AS confidence, round(round((abs(affect_valence) + affect_arousal) / 2, 9), 3) AS intensity, {afford} AS affordances FROM felt",
        "feeling_runs": f"""WITH {feeling_sql()}, c AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY source, label ORDER BY doc_id) AS island, array_to_string(list(label) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS previous FROM felt WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, label, row_number() OVER (PARTITION BY source, label, island ORDER BY doc_id) AS in_state, previous FROM c""",
        "predicted_type": f"""WITH {duck.NOTES}, {type_sql('notes')}, p AS (SELECT *, last_value(observed IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_type, CASE WHEN doc_id % 3 = 0 THEN text END AS ins, CASE WHEN doc_id % 3 = 1 THEN text END AS tex, CASE WHEN doc_id % 2 = 1 THEN text END AS con, doc_id % 8 + 1 AS pulse FROM typed),
s AS (SELECT *, {duck.hits(low, k.INFRASTRUCTURE)} AS i1, {duck.hits(low, k.PHILOSOPHICAL)} AS p1, {duck.hits(low, k.CONSOLIDATION)} AS c1, {duck.hits(ctx, k.INFRASTRUCTURE)} AS i2, {duck.hits(ctx, k.PHILOSOPHICAL)} + {duck.hits(ctx, k.GALLERY)} AS p2, {duck.hits(ctx, k.CONSOLIDATION)} AS c2, {duck.hits(ctx, k.COMPANION)} AS d2, {duck.hits(tex, k.PHILOSOPHICAL[:8])} AS hint FROM p),
g AS (SELECT *, greatest(i1, p1, c1) AS t1, greatest(i2, p2, c2, d2) AS t2 FROM s)
SELECT doc_id, CASE WHEN doc_id % 23 = 5 THEN 'companion' WHEN doc_id % 7 = 2 AND pulse = 1 THEN 'consolidation' WHEN pulse >= 5 AND t2 >= 2 THEN {pick('', 'i2', 'p2', 'c2', 'd2')} WHEN t1 >= 1 THEN {pick('', 'i1', 'p1', 'c1', None)} WHEN pulse BETWEEN 2 AND 4 AND t2 >= 2 THEN {pick('', 'i2', 'p2', 'c2', 'd2')} WHEN hint >= 3 THEN 'philosophical' ELSE coalesce(last_type, 'exploratory') END AS expected,
(CASE WHEN doc_id % 23 = 5 THEN 0.9 WHEN doc_id % 7 = 2 AND pulse = 1 THEN 0.6 WHEN pulse >= 5 AND t2 >= 2 THEN CASE WHEN t2 >= 5 THEN 0.6 ELSE 0.3 END WHEN t1 >= 1 THEN CASE WHEN t1 >= 2 THEN 0.6 ELSE 0.3 END WHEN pulse BETWEEN 2 AND 4 AND t2 >= 2 THEN CASE WHEN t2 >= 5 THEN 0.6 ELSE 0.3 END ELSE 0.3 END)::DOUBLE AS confidence FROM g""",
        "decayed_signals": f"""WITH RECURSIVE {ling}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM ling),
f AS (SELECT source, doc_id, i, {first} FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.i, {then} FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1) SELECT * EXCLUDE (i) FROM f""",
        "decayed_peaks_closed": f"WITH {ling}, o AS (SELECT doc_id, source, question_density AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS t FROM ling) SELECT doc_id, {duck.r3('greatest(0, max(x * (1 / 0.85::DOUBLE) ** t) OVER (PARTITION BY source ORDER BY doc_id) * 0.85::DOUBLE ** t)', 6)} AS peak FROM o",
        "elevation_streaks": f"""WITH {ling}, h AS (SELECT *, count(*) OVER w AS n, quantile_cont(hedging_ratio, 0.5) OVER w AS m, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM ling WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, coalesce(n >= 3 AND CASE WHEN m = 0 THEN hedging_ratio > 0.1 ELSE hedging_ratio > 1.5 * m END, false) AS elevated FROM h)
SELECT doc_id, elevated, i - coalesce(max(CASE WHEN NOT elevated THEN i END) OVER (PARTITION BY source ORDER BY doc_id), 0) AS streak FROM e""",
        "baseline_zscores": f"WITH {baseline_sql('source')} SELECT doc_id, observed, {', '.join(f'z_{c}' for c in Z)} FROM zs",
        "drives": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, {', '.join(f'{clamp(x)}::DOUBLE AS {d}' for d, x in drive.items())} FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, {', '.join(clamp(f'f.{d} + {x}') + '::DOUBLE' for d, x in drive.items())} FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, building, publishing, experimenting, (30 + CASE WHEN building > 0.3 THEN round_even((building - 0.3) / 0.7 * 15, 0) ELSE 0 END)::INT AS turns FROM f""",
    }
