"""Queries over conversation chunks: turns, pairs, windows, cleaning, tags and the feels score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import chunking, feels
from ..operators.tags import ALIASES, PRIORITY, filtered_by_tags, known_tags, primary_tags, scale, unknown_parts
from ..sources.tables import notes, talks
from . import duck

#: Windows of the correctness queries: size 4 instead of 5, which no small conversation reaches.
OVERLAPS = {1: 0, 2: 1, 3: 1, 4: 2}
RAW_TAGS = ["- Meta-Commentary, resolution / closure.", "* Affectively Loaded, unknown thing", "RESOLUTION / CLOSURE", "question,\nmeta   commentary, logistics, Hook;", " emotional ,, Closure: , filler"]


def coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.coalesced_turns(chunking.speaker_turns(talks(spark, sf_dir)))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dressed(chunking.chunk_windows(chunking.turn_pairs(coalesced(spark, sf_dir)), OVERLAPS))


def dressed(found: DataFrame) -> DataFrame:
    """Windows of pairs, with a date and tags derived from their numbers, as a tagger would add them."""
    tags = [["meta-commentary"], ["resolution / closure"], ["affectively loaded / emotional", "meta-commentary"], ["logistics"], []]
    which = F.pmod(F.col("conv_id") + F.col("chunk_index"), F.lit(5))
    chosen = F.element_at(F.array(*[F.array(*[F.lit(t) for t in x]).cast("array<string>") for x in tags]), (which + 1).cast("int"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("conv_id") * 7, F.lit(90)).cast("int"))
    return found.withColumn("tags", chosen).withColumn("source_date", date)


def q_coalesced_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesced(spark, sf_dir).select("conv_id", F.col("run").cast("long"), "turn", "role", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def q_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.turn_pairs(coalesced(spark, sf_dir)).select("conv_id", "pair", F.md5("voice_a").alias("a"), F.md5("voice_b").alias("b"))


def q_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("conv_id", "pair_count", "chunk_index", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feels.with_feels(chunks(spark, sf_dir))


def q_feels_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("conv_id", "pair_count", "chunk_index", "feels_score")


def q_feels_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, sf_dir).select("pair_count", F.explode("feels_components").alias("component", "value"))
    return found.groupBy("pair_count", "component").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def q_feels_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feels.summary_by_size(scored(spark, sf_dir))


def q_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    return feels.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.7, "cutoff")


def _dressed(text):  # noqa: ANN001, ANN202
    return F.concat(
        F.lit("=== Human ===\n<thinking>\nhidden\n</thinking>\n"), text, F.lit("   \n\n\n\n\n[attachment: a.png]\nKept Line.  \n=== Assistant ===\n<thinking>x</thinking>\nEnd. \n\n")
    )


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.md5(chunking.cleaned(_dressed(F.col("text")))).alias("digest"))


def q_label_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.array_join(chunking.labels(_dressed(F.col("text"))), "|").alias("labels"))


def q_mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", r"[^ -~\n]", "")
    return notes(spark, sf_dir).select("doc_id", F.md5(chunking.masked_names(_dressed(plain))).alias("digest"))


def q_clip_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", F.md5(chunking.clipped(F.col("text"), 3)).alias("digest"))


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import pick, table

    return table(spark, sf_dir, "documents").select("doc_id", pick(RAW_TAGS, F.col("doc_id")).alias("raw"), (F.pmod("doc_id", F.lit(6)) + 1).alias("pair_count"))


def q_tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_tags(F.col("raw"))
    return raw_tags(spark, sf_dir).select(
        "doc_id",
        F.array_join(known, "|").alias("known"),
        F.array_join(unknown_parts(F.col("raw")), "|").alias("unknown"),
        F.array_join(primary_tags(known), "|").alias("main"),
        scale(F.col("pair_count")).alias("scale"),
    )


def q_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw_tags(spark, sf_dir).withColumn("tags", known_tags(F.col("raw")))
    return filtered_by_tags(df, "tags", keep=["meta-commentary", "resolution / closure"], drop=["irrelevant filler"]).select("doc_id")


def feels_sql() -> str:
    low = "low"
    has = lambda tag: f"list_contains(tags, '{tag}')"
    lengths = f"list_filter(list_transform(regexp_split_to_array(low, '[.!?]\\s+'), lambda s: len({duck.words('s')})), lambda n: n > 2)"
    unc, clo = f"({duck.hits(low, L.UNCERTAINTY)} > 0)", f"({duck.hits(low, L.CLOSURE)} > 0)"
    return f"""{duck.CHUNKS},
l AS (SELECT *, lower(text) AS low FROM chunks),
m AS (SELECT *, {lengths} AS lengths FROM l),
parts AS (SELECT conv_id, pair_count, chunk_index, source_date, text,
  CASE WHEN {has('resolution / closure')} THEN -5.0::DOUBLE ELSE 3 END AS nonterminal,
  CASE WHEN {has('meta-commentary')} THEN 2.0::DOUBLE ELSE 0 END AS meta,
  ({duck.hits(low, L.HEDGES)} - 2 * {duck.hits(low, L.APOLOGIES)})::DOUBLE AS hedging,
  CASE WHEN {has('affectively loaded / emotional')} THEN -3.0::DOUBLE ELSE 0 END AS affect,
  CASE WHEN len(lengths) >= 2 THEN least(sqrt(greatest(0, list_sum(list_transform(lengths, lambda x: x * x)) / len(lengths) - (list_sum(lengths) / len(lengths)) ** 2)), 1.2) ELSE 0 END AS variance,
  CASE WHEN {duck.hits(low, L.PERMISSIONS)} > 0 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN {duck.hits(low, L.LIFTS)} > 0 THEN 1 ELSE 0 END AS permission,
  least(2.0 * {duck.hits(low, L.RESISTANCE)}, 4.0)::DOUBLE AS resistance,
  CASE WHEN NOT {has('meta-commentary')} THEN 0.0::DOUBLE WHEN {clo} THEN -4 WHEN {unc} THEN 3 ELSE 0 END AS liminal_meta,
  CASE WHEN pair_count IN (2, 3) THEN 1.2::DOUBLE WHEN pair_count = 1 THEN 0.8 WHEN pair_count >= 5 THEN 0.4 ELSE 1 END AS weight
  FROM m),
feels AS (SELECT *, round((nonterminal + meta + hedging + affect + variance + permission + resistance + liminal_meta) * weight, 3) AS feels_score FROM parts)"""


def tags_sql() -> tuple[str, str]:
    """The raw tags with their canonical names as ``known``, and the tags by priority as a list."""
    names_sql = "CASE x " + " ".join(f"WHEN {duck.lit(a)} THEN {duck.lit(b)}" for a, b in {**{t: t for t in PRIORITY}, **ALIASES}.items()) + " END"
    plain = "regexp_replace(regexp_replace(regexp_replace(lower(p), '^[-*\\s]+', ''), '\\s+', ' ', 'g'), '^[ .;:]+|[ .;:]+$', '', 'g')"
    listed = duck.array(PRIORITY)
    raw = f"""raw AS (SELECT doc_id, ({duck.array(RAW_TAGS)})[(doc_id % {len(RAW_TAGS)} + 1)::BIGINT] AS raw, (doc_id % 6 + 1)::INT AS pair_count FROM documents),
split AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '[,\\n]'), lambda p: {duck.stripped('p')}), lambda p: p <> '') AS parts FROM raw),
named AS (SELECT *, list_transform(list_transform(parts, lambda p: {plain}), lambda x: {names_sql}) AS names FROM split),
known AS (SELECT *, list_filter(names, lambda x, i: x IS NOT NULL AND list_position(names, x) = i) AS known FROM named)"""
    return raw, listed


def oracles() -> dict[str, str]:
    base, scored_sql = duck.CHUNKS, feels_sql()
    names = ["nonterminal", "meta", "hedging", "affect", "variance", "permission", "resistance", "liminal_meta"]
    stacked = " UNION ALL ".join(f"SELECT pair_count, '{n}' AS component, round({n}, 3) AS value FROM feels WHERE round({n}, 3) <> 0" for n in names)
    stacked += " UNION ALL SELECT pair_count, 'pair_weight', weight FROM feels WHERE weight <> 1"
    dressed = "'=== Human ===' || chr(10) || '<thinking>' || chr(10) || 'hidden' || chr(10) || '</thinking>' || chr(10) || text || '   ' || repeat(chr(10), 5) || '[attachment: a.png]' || chr(10) || 'Kept Line.  ' || chr(10) || '=== Assistant ===' || chr(10) || '<thinking>x</thinking>' || chr(10) || 'End. ' || chr(10) || chr(10)"
    raw, listed = tags_sql()
    clean = f"""lines AS (SELECT doc_id, unnest(string_split({dressed}, chr(10))) AS line, generate_subscripts(string_split({dressed}, chr(10)), 1) AS i FROM notes),
state AS (SELECT *, contains(line, '<thinking>') AND NOT contains(line, '</thinking>') AS opens, contains(line, '</thinking>') AS closes FROM lines),
inside AS (SELECT *, coalesce(last_value(CASE WHEN opens THEN 1 WHEN closes THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS within FROM state),
kept AS (SELECT doc_id, list(regexp_replace(line, '\\s+$', '') ORDER BY i) AS ls FROM inside WHERE within = 0 AND NOT opens AND NOT closes AND NOT starts_with(ltrim(line), '[attachment:') GROUP BY doc_id)"""
    return {
        "coalesced_turns": f"WITH {base} SELECT conv_id, run, turn, role, md5(text) AS digest, length(text)::INT AS chars FROM coalesced",
        "turn_pairs": f"WITH {base} SELECT conv_id, pair, md5(voice_a) AS a, md5(voice_b) AS b FROM pairs",
        "chunk_windows": f"WITH {base} SELECT conv_id, pair_count::INT AS pair_count, chunk_index, md5(text) AS digest, length(text)::INT AS chars FROM chunks",
        "feels_score": f"WITH {scored_sql} SELECT conv_id, pair_count::INT AS pair_count, chunk_index, feels_score FROM feels",
        "feels_components": f"WITH {scored_sql}, s AS ({stacked}) SELECT pair_count::INT AS pair_count, component, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY ALL",
        "feels_by_size": f"""WITH {scored_sql}, b AS (SELECT pair_count::INT AS pair_count, feels_score AS v FROM feels UNION ALL SELECT 0, feels_score FROM feels),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_count ORDER BY v) AS rn, count(*) OVER (PARTITION BY pair_count) AS n FROM b),
c AS (SELECT pair_count, v AS top_cutoff FROM r WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0)::BIGINT + 1)
SELECT b.pair_count, count(*) AS n, min(v) AS least, max(v) AS largest, round(avg(v), 6) AS mean, round(median(v), 6) AS median, any_value(top_cutoff) AS top_cutoff, count(*) FILTER (v >= top_cutoff) AS top_count
FROM b JOIN c USING (pair_count) GROUP BY b.pair_count""",
        "nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS cutoff FROM r WHERE rn = round_even((n - 1) * 0.7::DOUBLE, 0)::BIGINT + 1",
        "clean_text": f"WITH {duck.NOTES}, {clean} SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '^\\n+', ''), '\\n+$', ''), '\\n{{4,}}', repeat(chr(10), 3), 'g')) AS digest FROM kept",
        "label_detect": f"WITH {duck.NOTES} SELECT doc_id, array_to_string(regexp_extract_all({dressed}, '(?m)^===\\s*(.+?)\\s*===$', 1)[1:2], '|') AS labels FROM notes",
        "clip_sentences": f"WITH {duck.NOTES} SELECT doc_id, md5(array_to_string(string_split(regexp_replace({duck.stripped('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ')) AS digest FROM notes",
        "mask_names": f"WITH {duck.NOTES} SELECT doc_id, md5(array_to_string(list_transform(string_split({dressed.replace('|| text ||', "|| regexp_replace(text, '[^ -~' || chr(10) || ']', '', 'g') ||")}, chr(10)), lambda x: CASE WHEN starts_with(x, '===') THEN x ELSE regexp_replace(x, '\\b[A-Z][a-z]+\\b', '[x]', 'g') END), chr(10))) AS digest FROM notes",
        "tag_normalize": f"""WITH {raw} SELECT doc_id, coalesce(array_to_string(known, '|'), '') AS known, coalesce(array_to_string(list_filter(parts, lambda p, i: names[i] IS NULL), '|'), '') AS unknown,
coalesce(array_to_string(list_transform(list_sort(list_transform(known, lambda x: list_position({listed}, x)))[1:2], lambda i: ({listed})[i]), '|'), '') AS main, CASE WHEN pair_count <= 1 THEN 'micro' WHEN pair_count <= 3 THEN 'meso' ELSE 'macro' END AS scale FROM known""",
        "tag_filter": f"WITH {raw} SELECT doc_id FROM known WHERE NOT list_has_any(known, ['irrelevant filler']) AND list_has_any(known, ['meta-commentary', 'resolution / closure'])",
    }
