"""Queries over salience and sampling weights of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hits
from ..operators import chunking, saliency, sampling, windowed
from ..sources.tables import stored, table, talks
from . import chunks, duck

FAMILIES = saliency.heuristics("alex")
KEYS = [f"h_{name}" for name, _, _ in FAMILIES]
SWEEP = [(0.0, 1.0), (0.02, 1.2), (0.03, 1.3), (0.05, 1.3), (0.05, 1.5), (0.1, 2.0)]
TODAY = "2024-04-15"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saliency.with_salience(talks(spark, sf_dir), families=FAMILIES)


def q_salience_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("conv_id", "turn", "salience")


def q_salience_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("conv_id", "turn", *[F.round(k, 6).alias(k) for k in KEYS])


def with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saliency.with_context_bonus(segments(spark, sf_dir), "conv_id", "turn")


def q_salience_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_context(spark, sf_dir).select("conv_id", "turn", "context_bonus", "combined")


def q_salience_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = with_context(spark, sf_dir).where("combined >= 1").orderBy(F.desc("combined"), "conv_id", "turn").limit(10)
    return best.select("conv_id", "turn", "combined")


def q_salience_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_context(spark, sf_dir).groupBy("conv_id")
    return found.agg(F.max("combined").alias("salience"), F.max_by("turn", F.struct("combined", -F.col("turn"))).alias("turn"))


def q_salience_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saliency.distribution(stored(segments(spark, sf_dir).select("salience")), "salience")


def q_heuristic_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = segments(spark, sf_dir).agg(F.count("*").alias("all"), *[F.count(F.when(F.col(k) > 0, 1)).alias(k) for k in KEYS])
    pairs = F.array(*[F.struct(F.lit(k[2:]).alias("family"), F.col(k).alias("n")) for k in KEYS])
    rows = sums.select("all", F.explode(pairs).alias("x")).select("x.family", "x.n", F.round(F.col("x.n") * 100.0 / F.col("all"), 6).alias("percent"))
    return rows.where("n > 0").orderBy(F.desc("n"), "family").limit(10)


def both_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with feels score and the salience of their whole text."""
    return windowed.with_both_scores(chunking.turn_pairs(chunks.coalesced(spark, sf_dir)), chunks.OVERLAPS, FAMILIES, chunks.dressed)


def q_score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_scores(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.corr("feels_score", "salience"), 6).alias("r"))


def q_boost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of weight in each salience bucket, for several boost settings; the settings are a literal array."""
    configs = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(c).alias("cap")) for f, c in SWEEP])
    boosted = segments(spark, sf_dir).select("salience", F.explode(configs).alias("c"))
    weight = F.when(F.col("c.factor") <= 0, 1.0).otherwise(F.least(1 + F.col("salience") * F.col("c.factor"), F.col("c.cap")))
    sums = boosted.groupBy(F.col("c.factor").alias("factor"), F.col("c.cap").alias("cap"), saliency.bucket(F.col("salience")).alias("bucket"))
    sums = sums.agg(F.count("*").alias("n"), F.sum(weight).alias("mass"))
    from pyspark.sql import Window

    share = F.col("mass") / F.sum("mass").over(Window.partitionBy("factor", "cap"))
    return sums.select("factor", "cap", "bucket", "n", F.round(share, 6).alias("share"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decay state over chunk keys: 0.85 for every earlier selection, given for every third conversation."""
    chosen = table(spark, sf_dir, "conversations").where("conv_id % 3 = 1").select(F.col("conv_id").alias("_c"))
    return sampling.decayed_weights(chosen.withColumn("key", F.concat_ws("|", "_c", F.lit(1), F.lit(0))), "key")


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are stored, as a filter on them would else be planned before they are, and each made again for it."""
    scores = stored(both_scores(spark, sf_dir).select("conv_id", "pair_count", "chunk_index", "source_date", "feels_score", "salience"))
    keyed = scores.withColumn("key", F.concat_ws("|", "conv_id", "pair_count", "chunk_index"))
    return sampling.with_effective_score(keyed, state(spark, sf_dir), "key", F.lit(TODAY).cast("date")).where("feels_score >= 0")


def q_effective_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("decay", "recency", "boost", "effective")]
    return effective(spark, sf_dir).select("conv_id", "pair_count", "chunk_index", *rounded)


def pool(spark: SparkSession, sf_dir: str, bottom: bool = False) -> DataFrame:
    rounded = effective(spark, sf_dir).select("conv_id", "pair_count", "chunk_index", F.round("effective", 6).alias("effective"))
    return sampling.top_share(rounded, "pair_count", "effective", ["conv_id", "chunk_index"], 0.1 if bottom else 0.3, bottom)


def q_top_percentile_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("pair_count", "rank", "conv_id", "chunk_index", "effective")


def q_bottom_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir, True).select("pair_count", "rank", "conv_id", "chunk_index", "effective")


def q_softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = sampling.with_softmax(stored(pool(spark, sf_dir)), "pair_count", "effective", 1.5)
    return weighted.select("pair_count", "conv_id", "chunk_index", F.round("probability", 6).alias("probability"))


def q_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = sampling.with_softmax(stored(pool(spark, sf_dir)), "pair_count", "effective", 1.5)
    return sampling.weighted_sample(weighted, "probability", ["conv_id", "pair_count", "chunk_index"], 5, 11).select("conv_id", "pair_count", "chunk_index")


def q_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["conv_id", "pair_count", "chunk_index"]
    return sampling.uniform_sample(chunks.chunks(spark, sf_dir), keys, 8, 11).select(*keys)


def q_negated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return talks(spark, sf_dir).groupBy("role").agg(F.sum(hits(low, ["not", "no", "never"])).alias("hits"), F.count("*").alias("turns"))


def found_sql(p: str) -> str:
    """1 where the text has the pattern, else 0."""
    if "(?!" in p:  # the engine's expressions have no lookahead: matched somewhere with no '?' after it
        head = p.split("(?!")[0]
        return f"({duck.found('lower(text)', head + '[^?' + chr(92) + 'n]*(' + chr(92) + 'n|$)', 'is').replace('(?is)', '(?i)')})::INT"
    return f"{duck.found('lower(text)', p)}::INT"


def salience_sql(source: str, columns: str) -> str:
    def family(weight: float, patterns: list[str]) -> str:
        m = " + ".join(found_sql(p) for p in patterns)
        return f"(CASE WHEN ({m}) > 0 THEN {weight} * (1 + 0.5 * (({m}) - 1)) ELSE 0 END)::DOUBLE"

    each = ", ".join(f"{family(w, ps)} AS h_{n}" for n, w, ps in FAMILIES)
    return f"fam AS (SELECT {columns}, {each} FROM {source}), seg AS (SELECT *, round({' + '.join(KEYS)}, 6) AS salience FROM fam)"


def oracles() -> dict[str, str]:
    seg = f"{duck.TALKS}, {salience_sql('talks', 'conv_id, turn')}"
    bonus = """strong AS (SELECT *, CASE WHEN salience > 3 THEN salience ELSE 0 END AS s FROM seg),
ctx AS (SELECT *, round(0.3 * coalesce(lead(s) OVER w, 0) + 0.15 * coalesce(lag(s) OVER w, 0), 6)::DOUBLE AS context_bonus FROM strong WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
con AS (SELECT *, round(salience + context_bonus, 6) AS combined FROM ctx)"""
    both = f"{chunks.feels_sql()}, {salience_sql('feels', 'conv_id, pair_count, chunk_index, source_date, feels_score')}"
    halving = "-ln(2::DOUBLE) / ln(15::DOUBLE)"
    eff = f"""{both}, state AS (SELECT conv_id || '|1|0' AS key, 0.85::DOUBLE ** count(*) AS weight FROM conversations WHERE conv_id % 3 = 1 GROUP BY conv_id),
w AS (SELECT seg.*, coalesce(weight, 1) AS decay, (1.0::DOUBLE + greatest(date_diff('day', source_date, DATE '{TODAY}'), 0)) ** ({halving}) AS recency, least(1 + salience * 0.03::DOUBLE, 1.3) AS boost
  FROM seg LEFT JOIN state ON state.key = conv_id || '|' || pair_count || '|' || chunk_index WHERE feels_score >= 0),
eff AS (SELECT conv_id, pair_count::INT AS pair_count, chunk_index, decay, recency, boost, feels_score * decay * recency * boost AS effective FROM w)"""
    pools = """r AS (SELECT pair_count, conv_id, chunk_index, round(effective, 6) AS effective FROM eff),
top AS (SELECT *, row_number() OVER (PARTITION BY pair_count ORDER BY effective DESC, conv_id, chunk_index)::INT AS rank, row_number() OVER (PARTITION BY pair_count ORDER BY effective, conv_id DESC, chunk_index DESC)::INT AS low, count(*) OVER (PARTITION BY pair_count) AS n FROM r)"""
    sweep = ", ".join(f"({f}::DOUBLE, {c}::DOUBLE)" for f, c in SWEEP)
    index = lambda p: f"CASE WHEN {p} = 0.99 AND n < 100 THEN n - 1 ELSE floor(n * {p}::DOUBLE)::BIGINT END"
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    keyed = "conv_id || '|' || pair_count || '|' || chunk_index"
    stacked = " UNION ALL ".join(f"SELECT '{k[2:]}' AS family, count(*) FILTER ({k} > 0) AS n, count(*) AS all_n FROM fam" for k in KEYS)
    return {
        "salience_score": f"WITH {seg} SELECT conv_id, turn, salience FROM seg",
        "salience_heuristics": f"WITH {seg} SELECT conv_id, turn, {', '.join(f'round({k}, 6) AS {k}' for k in KEYS)} FROM seg",
        "salience_context": f"WITH {seg}, {bonus} SELECT conv_id, turn, context_bonus, combined FROM con",
        "salience_topk": f"WITH {seg}, {bonus} SELECT conv_id, turn, combined FROM con WHERE combined >= 1 ORDER BY combined DESC, conv_id, turn LIMIT 10",
        "salience_by_conversation": f"WITH {seg}, {bonus} SELECT conv_id, max(combined) AS salience, arg_max(turn, (combined, -turn)) AS turn FROM con GROUP BY conv_id",
        "salience_distribution": f"WITH {seg}, r AS (SELECT salience, row_number() OVER (ORDER BY salience) - 1 AS i, count(*) OVER () AS n FROM seg) SELECT count(*) AS n, min(salience) AS least, max(salience) AS largest, round(avg(salience), 6) AS mean, round(stddev_samp(salience), 5) AS stdev, {', '.join(f'min(salience) FILTER (i >= {index(p)}) AS {k}' for k, p in points.items())} FROM r",
        "heuristic_frequency": f"WITH {seg}, s AS ({stacked}) SELECT family, n, round(n * 100.0::DOUBLE / all_n, 6) AS percent FROM s WHERE n > 0 ORDER BY n DESC, family LIMIT 10",
        "score_correlation": f"WITH {both} SELECT count(*) AS n, round(corr(feels_score, salience), 6) AS r FROM seg",
        "boost_sweep": f"WITH {seg}, c(factor, cap) AS (VALUES {sweep}), b AS (SELECT factor, cap, CASE WHEN salience = 0 THEN 'zero' WHEN salience < 2 THEN 'low' WHEN salience < 4 THEN 'medium' ELSE 'high' END AS bucket, CASE WHEN factor <= 0 THEN 1 ELSE least(1 + salience * factor, cap) END AS w FROM seg, c), g AS (SELECT factor, cap, bucket, count(*) AS n, sum(w) AS mass FROM b GROUP BY ALL) SELECT factor, cap, bucket, n, round(mass / sum(mass) OVER (PARTITION BY factor, cap), 6) AS share FROM g",
        "effective_score": f"WITH {eff} SELECT conv_id, pair_count, chunk_index, round(decay, 6) AS decay, round(recency, 6) AS recency, round(boost, 6) AS boost, round(effective, 6) AS effective FROM eff",
        "top_percentile_pool": f"WITH {eff}, {pools} SELECT pair_count, rank, conv_id, chunk_index, effective FROM top WHERE rank <= greatest(1, floor(n * 0.3::DOUBLE))",
        "bottom_pool": f"WITH {eff}, {pools} SELECT pair_count, low AS rank, conv_id, chunk_index, effective FROM top WHERE low <= greatest(1, floor(n * 0.1::DOUBLE))",
        "softmax_weights": f"WITH {eff}, {pools}, p AS (SELECT *, exp((effective - max(effective) OVER g) / 1.5) AS e FROM top WHERE rank <= greatest(1, floor(n * 0.3::DOUBLE)) WINDOW g AS (PARTITION BY pair_count)) SELECT pair_count, conv_id, chunk_index, round(e / sum(e) OVER (PARTITION BY pair_count), 6) AS probability FROM p",
        "weighted_sample": f"WITH {eff}, {pools}, p AS (SELECT *, exp((effective - max(effective) OVER g) / 1.5) AS e FROM top WHERE rank <= greatest(1, floor(n * 0.3::DOUBLE)) WINDOW g AS (PARTITION BY pair_count)), q AS (SELECT *, e / sum(e) OVER (PARTITION BY pair_count) AS w FROM p) SELECT conv_id, pair_count, chunk_index FROM q ORDER BY -ln(({duck.draw(keyed, 11)} + 0.5::DOUBLE) / 281474976710656) / w, conv_id, pair_count, chunk_index LIMIT 5",
        "uniform_sample": f"WITH {duck.CHUNKS} SELECT conv_id, pair_count::INT AS pair_count, chunk_index FROM chunks ORDER BY {duck.draw(keyed, 11)}, conv_id, pair_count, chunk_index LIMIT 8",
        "negated_hits": f"WITH {duck.TALKS} SELECT role, sum({duck.hits('lower(text)', ['not', 'no', 'never'])})::BIGINT AS hits, count(*) AS turns FROM talks GROUP BY role",
    }
