"""Topics, references, queries, suppression and keyword retrieval over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import python_regex
from ..sources.tables import stored

K1, B = 1.2, 0.75
# Weight lost a pulse, below which a query is forgotten, and from which one is suppressed.
DECAY, FORGOTTEN, SUPPRESSED = 0.85, 0.05, 0.4


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), python_pattern()), lambda w: w != "")


def python_pattern() -> str:
    return r"(?U)[^\w]+"


def inverted_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(token, key, tf, size): how often each token occurs in each text, and the text's tokens."""
    split = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("size"), F.explode("_t").alias("token"))
    return split.groupBy("token", key, "size").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key, score, rank): the ``k`` best texts of each query by BM25.

    Only the postings of the queries' tokens are joined, and frequencies are counted on them; corpus size and mean
    length are one row. The postings are stored once. They lie by text before they meet the queries, whose tokens are
    broadcast, so that a text's scores are added up where they arise and only each task's best go on.
    """
    index = inverted_index(docs, key)
    wanted = queries.select(query, F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    sizes = docs.select(F.size(tokens(F.col("text"))).alias("n"))
    totals = sizes.agg(F.count("*").alias("_docs"), F.avg("n").alias("_mean"))
    hits = stored(index.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weighted = hits.repartition(F.col(key)).join(F.broadcast(df), "token").crossJoin(F.broadcast(totals))
    idf = F.ln(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("_mean")))
    scores = weighted.withColumn("part", part).select(key, "token", "part").join(F.broadcast(wanted), "token").groupBy(query, key).agg(F.round(F.sum("part"), 6).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


def categories(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the categories with a keyword in the text."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)), name) for name, ws in keywords.items()]), lambda c: c.isNotNull())


def file_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([\w/-]+\.(?:py|md|json|yaml|ts))\b"), F.lit(1))))


def issue_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,5}-\d+)\b"), F.lit(1))))


def suppression(offers: DataFrame, query: str, pulse: str, now: int) -> DataFrame:
    """(query, weight, offered, suppressed) at pulse ``now``: 1 at the last offer, 0.85 of it each pulse since."""
    last = offers.where(F.col(pulse) <= now).groupBy(query).agg(F.max(pulse).alias("_last"), F.count("*").alias("offered"))
    weighed = last.withColumn("weight", F.round(F.pow(F.lit(DECAY), now - F.col("_last")), 6)).where(F.col("weight") >= FORGOTTEN)
    return weighed.withColumn("suppressed", F.col("weight") >= SUPPRESSED).drop("_last")


def query_plan(candidates: DataFrame, group: str, most: int = 8) -> DataFrame:
    """Candidates (origin, query, position) by origin: instructions, then feelings, then categories; each query once."""
    order = F.when(F.col("origin") == "instructions", 0).when(F.col("origin") == "feeling", 1).otherwise(2)
    first = candidates.withColumn("_o", order).groupBy(group, "query").agg(F.min(F.struct("_o", "position", "origin")).alias("m"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("m._o", "m.position", "query"))
    least = F.when(F.col("m._o") == 2, 5.0).otherwise(2.0)
    return first.select(group, "query", F.col("m.origin").alias("origin"), least.alias("min_score"), place.alias("place")).where(F.col("place") <= most)


def pointers(results: DataFrame, query: str, key: str, least: Column, most: int = 4) -> DataFrame:
    """Per query the best strong result and how many there are; the ``most`` best queries."""
    strong = results.where(F.col("score") >= least)
    best = strong.groupBy(query).agg(F.max_by(key, F.struct("score", -F.col(key))).alias("top"), F.max("score").alias("score"), F.count("*").alias("n"))
    return best.orderBy(F.desc("score"), query).limit(most)


def hint(text: Column, most: int = 100) -> Column:
    """The first useful line of ten characters or more, cut at a word."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 10) & ~x.startswith("#") & ~x.startswith("---"))
    line = F.get(lines, F.lit(0))
    return F.when(F.length(line) <= most, line).otherwise(F.regexp_replace(F.substring(line, 1, most), r"\s+\S*$", "")).alias("hint")


def sanitised(query: Column) -> Column:
    """A query of words only: everything but letters, digits, underscores and hyphens is a space."""
    plain = F.regexp_replace(query, python_regex(r"[^\w\s-]", ""), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
