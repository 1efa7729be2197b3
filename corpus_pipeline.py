"""A corpus pipeline: drop toxic documents, join near copies, cut repeated strings, mix domains, encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.bpe import encode_documents
from quillstream.llm.common import read, stored
from quillstream.llm.jaccard_join import keep_one_of_class
from quillstream.llm.mixing import mix_sources
from quillstream.llm.queries import tokenizer
from quillstream.llm.suffix_dedup import remove_passages_from_texts
from quillstream.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.5, each row judged by its whole text.

    A null or empty text scores low and stays, as do repeated rows, each by itself; without labels all stay; an empty
    table stays empty; other columns are carried through under any name.
    """
    row = F.struct(*docs.columns)
    scored = score_toxicity(docs.select(row.alias("row"), "doc_id", "text"), read(spark, sf_dir, "labels"), keep=True)
    return scored.where("predicted = 0").select("row.*")


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least doc_id.

    Of equal texts (null, empty and repeated ones included) one row stays; ties of doc_id go to any of equal rows; an
    empty table stays empty; other columns are carried through under any name.
    """
    return keep_one_of_class(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that other documents have too.

    A document that is one such passage goes; null, empty and short texts stay; an empty table stays empty; other
    columns are carried through under any name.
    """
    return remove_passages_from_texts(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of rarer domains as often as their rates say.

    Rows equal in doc_id and text get as many copies each; a null or empty text has rate 1 or more and stays; without
    labels there is one domain and nothing is repeated; an empty table stays empty; other columns are carried through
    under any name.
    """
    rates = mix_sources(docs, least=1.0).select(F.col("doc_id").alias("rated"), "crc", "copies").dropDuplicates(["rated", "crc"])
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), crc.alias("own"))
    joined = rows.join(rates, F.col("doc").eqNullSafe(F.col("rated")) & (F.col("own") == F.col("crc")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, one row a row; null and empty texts have no tokens."""
    return encode_documents(docs, *tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_array_dedup", cut_repeated_strings),
    ("mixing", mix_domains),
    ("byte_bpe", encode),
]
#: Fitted models and sketches are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
