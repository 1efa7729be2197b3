"""One query for each operator of this subpackage, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_documents, load_ranks
from .codes import coded
from .common import read
from .conversations import repaired
from .jaccard_join import join_near_texts
from .langid import identify
from .mixing import mix_sources
from .pii import personal_data
from .quality import filter_quality
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity
from .url_filter import filter_urls

#: A dated URL list in the form that ``filter_urls`` takes; a deployment passes its own table.
URL_LIST = [
    ("domain", "spam-farm.example.org", "add", "2023-11-02 00:00:00"),
    ("domain", "spam-farm.example.org", "remove", "2024-05-15 12:00:00"),
    ("domain", "spam-farm.example.org", "add", "2024-08-01 00:00:00"),
    ("domain", "cheap-pills.example.com", "add", "2024-02-10 06:30:00"),
    ("domain", "casino-win.example.com", "add", "2024-03-01 00:00:00"),
    ("domain", "casino-win.example.com", "remove", "2024-09-30 00:00:00"),
    ("domain", "free-bets.example.com", "add", "2023-06-01 00:00:00"),
    ("host", "blog.tionsh.example.com", "add", "2024-04-01 00:00:00"),
    ("host", "blog.tionsh.example.com", "remove", "2024-04-08 00:00:00"),
    ("host", "tionsh.example.net", "add", "2024-06-01 00:00:00"),
    ("host", "tionsh.example.net", "remove", "2024-06-21 00:00:00"),
    ("prefix", "tiontion.example.net/en", "add", "2024-01-20 00:00:00"),
    ("prefix", "tiontion.example.net/en", "remove", "2024-07-20 00:00:00"),
    ("domain", "ththth.example.net", "add", "2024-10-01 00:00:00"),
    ("domain", "ththth.example.net", "remove", "2024-10-01 00:00:00"),
]
#: The pages table has no fetch time: page p counts as fetched p * FETCH_STEP minutes into 2024 (modulo a year).
FETCH_STEP, YEAR_MINUTES = 7919, 366 * 24 * 60


def tokenizer() -> tuple[list[bytes], str]:
    """Tokens by rank and the split pattern of the multilingual byte-level vocabulary."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("crc")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), *tokenizer())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near_texts(read(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str, entries: DataFrame | None = None, captures: DataFrame | None = None) -> DataFrame:
    """The list (kind, entry, action, at) and the captures (page_id, url, fetched_at) are tables of the deployment; without
    them the literal list above and pages, whose fetch times follow from their numbers."""
    if captures is None:
        minutes = F.pmod(F.col("page_id") * FETCH_STEP, F.lit(YEAR_MINUTES))
        fetched = F.timestamp_micros((F.lit(1704067200) + minutes * 60) * 1000000)
        captures = read(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    if entries is None:
        entries = spark.createDataFrame(URL_LIST, "kind string, entry string, action string, at string").withColumn("at", F.to_timestamp("at"))
    return filter_urls(captures, entries)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import queries_sql

    return queries_sql.oracles()
