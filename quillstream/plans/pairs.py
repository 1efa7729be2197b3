"""Queries over the pairs of chunk records: blocks, filters, selection, skips and seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, pairs, saliency, sampling
from ..operators.tags import known_tags, scale
from ..sources import files
from ..sources.tables import table, talks
from . import chunks, duck, salience

SIZES, OVERLAPS = "1,2,3", "2:1, 3:2"
SCALES = ["Meso", " macro"]


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): each conversation as text with a header line before every turn; system turns are notes."""
    even = F.pmod("conv_id", F.lit(2)) == 0
    name = F.when(F.col("role") == "user", F.when(even, "Human").otherwise("W")).when(F.col("role") == "assistant", F.when(even, "Assistant").otherwise("C")).otherwise("Notes")
    block = F.concat(F.lit("=== "), name, F.lit(" ===\n"), "text", F.lit("\n\n"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("_t"))
    return turns.select("conv_id", F.concat(F.lit("# Conversation: c\nbefore\n"), F.array_join(F.transform("_t", lambda t: t["b"]), "")).alias("text"))


def q_block_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.role_blocks(transcripts(spark, sf_dir), "conv_id")
    return found.select("conv_id", "block", "role", F.md5("text").alias("digest"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunk records: turns two by two, with keys of either kind, blank and missing voices."""
    voice = lambda k: F.max(F.when(F.pmod("turn", F.lit(2)) == k, F.col("text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("p")).agg(voice(0).alias("a"), voice(1).alias("b"))
    k = F.pmod(F.col("conv_id") + F.col("p"), F.lit(6))
    new, old = F.when(k != 0, F.col("a")), F.when(k == 0, F.col("a"))
    said = F.when(k == 1, F.lit(" \n ")).when(~k.isin(0, 2), F.col("b"))
    pair = F.struct(new.alias("voice_a"), said.alias("voice_b"), old.alias("human"), F.when(k == 0, F.col("b")).alias("assistant"))
    grouped = rows.select("conv_id", F.struct("p", pair.alias("pair")).alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select("conv_id", F.transform("x", lambda x: x["pair"]).alias("pairs"), F.when(F.pmod("conv_id", F.lit(5)) > 0, F.size("x")).alias("pair_count"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p: F.concat(p["voice_a"], F.lit("|"), p["voice_b"])), "#")


def q_clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records(spark, sf_dir).withColumn("pairs", pairs.full_pairs(pairs.standard_pairs(F.col("pairs")), 20))
    return pairs.recounted(kept).select("conv_id", "pair_count", "pair_count_original", F.md5(joined(F.col("pairs"))).alias("digest"))


def q_shard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = F.when(F.pmod("conv_id", F.lit(3)) == 0, "first").when(F.pmod("conv_id", F.lit(3)) == 1, "last").otherwise("random")
    kept = records(spark, sf_dir).withColumn("pairs", pairs.standard_pairs(F.col("pairs")))
    chosen = kept.withColumn("pairs", pairs.selected_pairs(F.col("pairs"), 1, how, ["conv_id"], 9))
    clip = lambda p: F.struct(chunking.clipped(p["voice_a"], 2).alias("voice_a"), chunking.clipped(p["voice_b"], 2).alias("voice_b"))
    texts = chosen.withColumn("text", joined(F.transform("pairs", clip))).where(pairs.long_enough(F.col("text")))
    return texts.select("conv_id", F.size("pairs").alias("n"), F.md5("text").alias("digest"))


def q_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.pmod("doc_id", F.lit(10)) / 2)
    return table(spark, sf_dir, "documents").select("doc_id", pairs.score_once(existing, F.char_length("text") / 1000).alias("score"))


def q_retagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.pmod("doc_id", F.lit(4)) > 0, known_tags(F.col("raw")))
    given = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.array(F.lit("given")))
    rows = chunks.raw_tags(spark, sf_dir).withColumn("tags", tags).withColumn("tags_primary", given).withColumn("scale", F.when(F.pmod("doc_id", F.lit(5)) == 0, "own"))
    return pairs.tag_once(rows).select("doc_id", "skipped", F.array_join("tags_primary", "|").alias("main"), "scale")


def q_scale_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = chunks.scored(spark, sf_dir).withColumn("scale", scale(F.col("pair_count")))
    return pairs.candidates(scored, 1.0, SCALES).select("conv_id", "pair_count", "chunk_index", "scale")


def q_record_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.first_records(chunks.chunks(spark, sf_dir).select("conv_id", "pair_count", "chunk_index"), ["conv_id", "pair_count", "chunk_index"], 25)


def q_replacement_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 1.0).alias("weight"))
    return sampling.draw_with_replacement(weighted, "weight", ["c_custkey"], 9, 3)


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.chunks(spark, sf_dir)
    return found.select("conv_id", "pair_count", "chunk_index", files.chunk_id(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")), F.col("pair_count"), F.col("chunk_index")).alias("chunk_id"))


def q_overlap_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunk_windows(chunking.turn_pairs(chunks.coalesced(spark, sf_dir)), pairs.parsed_overlaps(SIZES, OVERLAPS))
    return found.groupBy("pair_count").agg(F.count("*").alias("n"))


def q_salience_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = saliency.family_scores(F.lower("text"), salience.FAMILIES, linear=False)
    return talks(spark, sf_dir).select("conv_id", "turn", F.round(sum(scores.values(), F.lit(0.0)), 6).alias("salience"))


def q_heuristic_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = saliency.heuristic("emotional_texture", "alex")
    return talks(spark, sf_dir).select("conv_id", "turn", F.round(saliency.family_scores(F.lower("text"), [family])[family[0]], 6).alias("score"))


def q_tag_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.raw_tags(spark, sf_dir).select("pair_count", (F.pmod("doc_id", F.lit(3)) == 0).alias("skipped"), F.when(F.pmod("doc_id", F.lit(11)) == 4, "timeout").alias("error"))
    return pairs.bookkeeping(rows, ["pair_count"], "skipped", "error")


def oracles() -> dict[str, str]:
    draw = duck.draw
    ends = "regexp_replace({}, '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')".format("text")
    rec = """w AS (SELECT conv_id, (turn // 2)::BIGINT AS p, max(text) FILTER (turn % 2 = 0) AS a, max(text) FILTER (turn % 2 = 1) AS b FROM conversations GROUP BY ALL),
v AS (SELECT conv_id, p, (conv_id + p) % 6 AS k, a, CASE WHEN (conv_id + p) % 6 = 1 THEN ' ' || chr(10) || ' ' WHEN (conv_id + p) % 6 <> 2 THEN b END AS b FROM w),
n AS (SELECT conv_id, count(*) AS pc FROM w GROUP BY conv_id)"""
    clip = lambda c: f"array_to_string(string_split(regexp_replace({duck.stripped(c)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ')"
    raw, listed = chunks.tags_sql()
    main = f"array_to_string(list_transform(list_sort(list_transform(known, lambda x: list_position({listed}, x)))[1:2], lambda i: ({listed})[i]), '|')"
    draft = " + ".join(f"{w} * ({' + '.join(salience.found_sql(p) for p in ps)})" for _, w, ps in salience.FAMILIES)
    return {
        "block_turns": f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS block, role, regexp_replace({ends}, '\\n+$', '') AS body FROM conversations)
SELECT conv_id, block, CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END AS role, md5(body) AS digest FROM t WHERE role IN ('user', 'assistant') AND body <> ''""",
        "clean_pairs": f"""WITH {rec}, c AS (SELECT * FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND length({duck.stripped('a')}) >= 20 AND length({duck.stripped('b')}) >= 20),
g AS (SELECT conv_id, count(*)::INT AS m, md5(string_agg(a || '|' || b, '#' ORDER BY p)) AS digest FROM c GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 5 > 0 THEN m END AS pair_count, CASE WHEN conv_id % 5 > 0 AND m <> pc THEN pc END::INT AS pair_count_original, digest FROM g JOIN n USING (conv_id)""",
        "shard_pairs": f"""WITH {rec}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM v WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT * FROM r WHERE i = CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN m - 1 ELSE {draw('conv_id', 9)} % m END), t AS (SELECT conv_id, {clip('a')} || '|' || {clip('b')} AS text FROM s)
SELECT conv_id, 1 AS n, md5(text) AS digest FROM t WHERE length(text) >= 40""",
        "rescored": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 2::DOUBLE ELSE round(length(text) / 1000::DOUBLE, 3) END AS score FROM documents",
        "retagged": f"""WITH {raw}, r AS (SELECT *, doc_id % 4 > 0 AND len(known) > 0 AS tagged FROM known) SELECT doc_id, tagged AS skipped, CASE WHEN doc_id % 7 = 0 THEN 'given' WHEN tagged THEN {main} END AS main,
CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN tagged THEN CASE WHEN pair_count <= 1 THEN 'micro' WHEN pair_count <= 3 THEN 'meso' ELSE 'macro' END END AS scale FROM r""",
        "scale_candidates": f"WITH {chunks.feels_sql()} SELECT conv_id, pair_count::INT AS pair_count, chunk_index, CASE WHEN pair_count <= 3 THEN 'meso' ELSE 'macro' END AS scale FROM feels WHERE feels_score >= 1 AND pair_count > 1",
        "record_limit": f"WITH {duck.CHUNKS} SELECT conv_id, pair_count::INT AS pair_count, chunk_index FROM chunks ORDER BY ALL LIMIT 25",
        "replacement_draws": f"""WITH d AS (SELECT i::INT AS draw, c_custkey, -ln(({draw('c_custkey', '(3000 + i)')} + 0.5::DOUBLE) / 281474976710656) / (c_nationkey + 1) AS t FROM customer, range(9) r(i))
SELECT draw, arg_min(c_custkey, (t, c_custkey)) AS c_custkey FROM d GROUP BY draw""",
        "chunk_ids": f"WITH {duck.CHUNKS} SELECT conv_id, pair_count::INT AS pair_count, chunk_index, sha1('conv_' || conv_id || '|' || pair_count || '|' || chunk_index) AS chunk_id FROM chunks",
        "overlap_config": f"WITH {duck.CHUNKS}, m AS (SELECT conv_id, count(*) AS n FROM pairs GROUP BY conv_id), s(pair_count) AS (VALUES (1), (2), (3)) SELECT pair_count::INT AS pair_count, sum(n - pair_count + 1)::BIGINT AS n FROM m, s WHERE n >= pair_count GROUP BY pair_count",
        "heuristic_by_name": f"WITH {duck.TALKS}, {salience.salience_sql('talks', 'conv_id, turn')} SELECT conv_id, turn, round(h_emotional_texture, 6) AS score FROM seg",
        "tag_counters": "SELECT (doc_id % 6 + 1)::INT AS pair_count, count(*) AS seen, count(*) FILTER (doc_id % 3 = 0) AS skipped, count(*) FILTER (doc_id % 3 > 0 AND doc_id % 11 <> 4) AS done, count(*) FILTER (doc_id % 3 > 0 AND doc_id % 11 = 4) AS failed FROM documents GROUP BY 1",
        "salience_draft": f"WITH {duck.TALKS} SELECT conv_id, turn, round(({draft})::DOUBLE, 6) AS salience FROM talks",
    }
