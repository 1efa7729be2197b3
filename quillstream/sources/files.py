"""File sources and sinks: transcripts, JSON lines, notes, logs, lexicons, incremental discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parsers import migrated_labels


def transcripts(spark: SparkSession, root: str, name: str = "conversation.md") -> DataFrame:
    """(path, modified, size, text) of all files of a name under a folder, each read whole."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    meta = F.col("_metadata")
    return files.select(meta["file_path"].alias("path"), meta["file_modification_time"].alias("modified"), meta["file_size"].alias("size"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines by an explicit schema; lines that are not JSON are dropped, missing fields are null."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    bad = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(bad).json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, date, lines, first_line) of Markdown notes."""
    files = transcripts(spark, root, "*.md")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("path"), F.nullif(F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")).alias("date"),
        F.size(F.split("text", "\n")).alias("lines"), F.trim(F.split("text", "\n")[0]).alias("first_line"),
    )


def time_of_name(name: Column) -> Column:
    """Time in names such as 2024-05-01_123000_x; null if malformed."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{6})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd_HHmmss"))


def in_range(logs: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Logs whose name has a time from start to end, both included."""
    return logs.withColumn("at", time_of_name(F.col(name))).where(F.col("at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def vad_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated lexicon with a header: word, valence, arousal."""
    return spark.read.csv(path, sep="\t", header=True, schema="word string, valence double, arousal double").where("word IS NOT NULL")


def conversation_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^#\s*Conversation:\s*(.+?)\s*$", 1), F.lit(""))


def folder_date(path: Column) -> Column:
    """Date at the start of the parent folder's name, after an optional number."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.nullif(F.regexp_extract(folder, r"^(?:\d+_)?(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def discover(files: DataFrame, state: DataFrame, reprocess: bool = False) -> DataFrame:
    """Files to process: unknown ones, and with ``reprocess`` those whose time or size changed."""
    known = state.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"))
    joined = files.join(known, "path", "left")
    changed = (F.col("modified") != F.col("_m")) | (F.col("size") != F.col("_s"))
    return joined.where(F.col("_m").isNull() | (changed if reprocess else F.lit(False))).drop("_m", "_s")


def chunk_id(path: Column, size: Column, index: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, size.cast("string"), index.cast("string")).cast("binary"))


def append_by_size(chunks: DataFrame, path: str) -> None:
    """Append chunks as JSON lines, one folder a window size, so that readers of one size skip the others."""
    chunks.write.mode("append").partitionBy("pair_count").json(path)


def with_errors_aside(df: DataFrame, error: str, good: str, bad: str) -> None:
    """Write rows without an error to one place and the others, with it, to another."""
    df.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(good)
    df.where(F.col(error).isNotNull()).write.mode("append").json(bad)


def audit(calls: DataFrame, level: str) -> DataFrame:
    """Audit records to keep: none, errors_only or all."""
    return calls.where({"none": "false", "errors_only": "NOT success", "all": "true"}[level])


def rebuild(chunks: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Replace all chunks under a path by these, or with ``dry_run`` leave it as it is; returns how many of each size."""
    if not dry_run:
        chunks.write.mode("overwrite").partitionBy("pair_count").json(path)
    return chunks.groupBy("pair_count").agg(F.count("*").alias("n"))


def note_hash(name: Column, modified: Column) -> Column:
    """Name and whole second of the last change, by which a note counts as seen."""
    return F.concat_ws(":", name, F.floor(F.unix_micros(modified) / 1_000_000).cast("string"))


def migrated_tree(transcripts: DataFrame, path: str | None = None) -> DataFrame:
    """Per file how many speaker headers are shortened; with a path the new texts are written there (else a dry run)."""
    text, human, assistant = migrated_labels(F.col("text"))
    changed = transcripts.select("path", text.alias("text"), human.alias("humans"), assistant.alias("assistants"))
    if path is not None:
        changed.select("path", "text").write.mode("overwrite").parquet(path)
    return changed.select("path", "humans", "assistants")


def trigger_files(spark: SparkSession, folder: str, archive: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A stream of the JSON lines of files that appear in a folder, and are archived once read.

    ``event`` is null where a line is not JSON; such lines keep their text in ``bad``, to be put aside.
    """
    lines = spark.readStream.option("cleanSource", "archive").option("sourceArchiveDir", archive).option("maxFilesPerTrigger", per_batch).text(folder)
    event = F.from_json("value", schema)
    valid = F.try_parse_json("value").isNotNull()
    return lines.select(F.when(valid, event).alias("event"), F.when(~valid, F.col("value")).alias("bad"))
