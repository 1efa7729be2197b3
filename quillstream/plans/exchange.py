"""Queries over what is written to files and read back: chunk lines, deltas, lexicons, errors, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs import Job, Registry, loaded
from ..operators.tags import scale
from ..sources import commits, files
from ..sources.tables import TASK_ROWS, dealt, scratch, table
from ..streaming import windows
from . import chunks, duck

LINE = "conv_id long, chunk_index int, text string, missing string"


def q_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks rebuilt as JSON lines by size, a delta appended, broken lines added; what is read back, by size."""
    path, found = scratch(spark, "exchange"), chunks.chunks(spark, sf_dir).select("conv_id", "pair_count", "chunk_index", "text")
    files.rebuild(found, path)
    planned = files.rebuild(found.where("pair_count > 1"), path, dry_run=True)  # changes nothing
    files.append_by_size(found.where("conv_id % 2 = 0"), path)
    spark.range(3).select(F.lit("{broken").alias("value")).write.text(f"{path}/pair_count=1/more")
    read = files.json_lines(spark, path, LINE + ", pair_count int")
    counted = read.groupBy("pair_count").agg(F.count("*").alias("lines"), F.count("missing").alias("missing"), F.sum(F.length("text")).alias("chars"))
    return counted.join(planned.withColumnRenamed("n", "planned"), "pair_count", "left")


def tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def words_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark texts with a valence by their length and an arousal by their first letter."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("word")).distinct()
    return words.select("word", ((F.length("word") % 5 - 2) / 2).alias("valence"), ((F.ascii("word") % 7 - 3) / 4).alias("arousal"))


def q_lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon of the benchmark's words, written with tabs and a header, and read by its schema."""
    path = scratch(spark, "exchange")
    words_with_values(spark, sf_dir).write.csv(path, sep="\t", header=True)
    return files.vad_lexicon(spark, path)


def q_lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents held against the lexicon read from its file: hits and their mean valence and arousal."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens("text")).alias("word")).groupBy("doc_id", "word").count()
    hits = words.join(q_lexicon_file(spark, sf_dir), "word").groupBy("doc_id")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("count")) / F.sum("count"), 6).alias(c)
    return hits.agg(F.sum("count").alias("hits"), mean("valence"), mean("arousal"))


def q_incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, two thirds of which are there at first, processed into two tables by three runs; both in the end."""
    store = commits.Store(spark, scratch(spark, "store"))
    listing = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.timestamp_seconds("doc_id").alias("modified"), F.octet_length("text").cast("long").alias("size"))
    sinks = {"lines": lambda new: new.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines")), "index": lambda new: new.select("doc_id", "size")}
    for look in (listing.where("doc_id % 3 > 0"), listing.where("doc_id % 3 > 0"), listing):
        commits.incremental(store, look, sinks)
    store.compact("lines", "doc_id long, lines long")
    return store.read("lines", "doc_id long, lines long").join(store.read("index", "doc_id long, size long"), "doc_id")


def q_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in five steps, one of them twice, compacted on the way; what the log says of each type."""
    store, events = commits.Store(spark, scratch(spark, "store")), table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    for step in range(5):
        for _ in range(1 + (step == 2)):
            store.commit("events", step, {"log": events.where(F.pmod("event_id", F.lit(5)) == step)})
        if step == 3:
            store.compact("log", events.schema)
    return types_of(store.read("log", events.schema))


def types_of(log: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows, different ids and last time of each type of event."""
    ids = dealt(log, ["event_type", "event_id"], task_rows).groupBy("event_type", "event_id").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    return ids.groupBy("event_type").agg(F.sum("_n").alias("n"), F.count("event_id").alias("distinct"), F.max("_last").alias("last"))


def q_errors_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without an error in one place, the others with it in another."""
    good, bad = scratch(spark, "exchange"), scratch(spark, "exchange")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), F.col("event_id").cast("string")))
    files.with_errors_aside(table(spark, sf_dir, "events").select("event_id", "event_type", error.alias("problem")), "problem", good, bad)
    kept, aside = spark.read.parquet(good), spark.read.schema("event_id long, event_type string, problem string").json(bad)
    return kept.select("event_id", F.lit(None).cast("string").alias("problem")).unionByName(aside.select("event_id", "problem"))


def q_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to process by a listing and a state: unknown ones, and in a second look also those that changed."""
    listing = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), "event_id", F.col("ts").alias("modified"), F.pmod("event_id", F.lit(90)).alias("size"))
    state = listing.where("event_id % 3 > 0").select("path", "modified", F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit(-1)).otherwise(F.col("size")).alias("size"))
    looks = [files.discover(listing, state, again).select("event_id", F.lit(again).alias("reprocess")) for again in (False, True)]
    return looks[0].unionByName(looks[1])


def q_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names and first lines of transcripts tell: conversation, date of the folder, size class."""
    k = F.pmod("conv_id", F.lit(4))
    path = F.concat(F.lit("/a/"), F.when(k == 0, "7_").otherwise(""), F.when(k < 3, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("conv_id", F.lit(60)).cast("int")), "yyyy-MM-dd")).otherwise("undated"), F.lit("_t/conversation.md"))
    text = F.concat(F.when(k == 1, "note\n").otherwise(""), F.when(k < 3, F.concat(F.lit("#  Conversation:  talk "), F.col("conv_id").cast("string"), F.lit(" \n"))).otherwise("#Other\n"), F.lit("=== Human ===\nx"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", files.conversation_name(text).alias("name"), files.folder_date(path).alias("date"), scale(F.pmod("conv_id", F.lit(6)) + 1).alias("scale"))


def q_label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker headers shortened over all files: a dry run's counts, and what was written then."""
    text = F.concat(F.lit("=== Human ===\n"), "text", F.lit("\n=== Assistant ===\n=== Human ==="))
    tree = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), text.alias("text"))
    path = scratch(spark, "exchange")
    planned = files.migrated_tree(tree)
    files.migrated_tree(tree, path)
    written = spark.read.parquet(path).select("path", F.regexp_count("text", F.lit("(?m)^=== [HC] ===$")).alias("written"))
    return planned.join(written, "path").select("path", F.col("humans").cast("long"), F.col("assistants").cast("long"), F.col("written").cast("long"))


def q_stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger files of signups, among them lines that are no JSON, read as a stream and archived."""
    inbox, archive = scratch(spark, "exchange"), scratch(spark, "exchange")
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    line = F.when(F.pmod("event_id", F.lit(7)) == 0, F.concat(F.lit("{bad "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "user_id")))
    events.select(line.alias("value")).write.text(inbox)
    stream = files.trigger_files(spark, inbox, archive, "event_id long, user_id long")
    return windows.drained(stream.select("event.event_id", "event.user_id", "bad"), scratch(spark, "stream"), "append")


def q_job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three jobs of a registry, run by priority: one written, one planned, one that fails."""
    registry = Registry().add(Job("count", lambda s: table(s, sf_dir, "events").groupBy("user_id").count(), scratch(spark, "exchange"), 20)).add(loaded("none", f"{__name__}:oracles"))
    registry.add(Job("plan", lambda s: table(s, sf_dir, "region"), priority=10))
    for name in registry.names():
        registry.run(spark, name, dry_run=name == "plan")
    return registry.records(spark)


def oracles() -> dict[str, str]:
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: length(w) >= 3)"
    lexicon = f"lx AS (SELECT DISTINCT word, (length(word) % 5 - 2) / 2::DOUBLE AS valence, (ord(word) % 7 - 3) / 4::DOUBLE AS arousal FROM (SELECT unnest({words}) AS word FROM benchmark))"
    return {
        "label_tree": "SELECT 'd' || doc_id AS path, 2::BIGINT AS humans, 1::BIGINT AS assistants, 3::BIGINT AS written FROM documents",
        "stream_triggers": "SELECT CASE WHEN event_id % 7 > 0 THEN event_id END AS event_id, CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 7 = 0 THEN '{bad ' || event_id END AS bad FROM events WHERE event_type = 'signup'",
        "job_runs": "SELECT job, status, dry_run, error, CASE WHEN job = 'count' THEN (SELECT count(DISTINCT user_id) FROM events) END AS rows FROM (VALUES ('plan', 'planned', true, NULL), ('count', 'completed', false, NULL), ('none', 'failed', false, 'TypeError')) v(job, status, dry_run, error)",
        "chunk_lines": f"""WITH {duck.CHUNKS}, a AS (SELECT pair_count, text FROM chunks UNION ALL SELECT pair_count, text FROM chunks WHERE conv_id % 2 = 0)
SELECT pair_count::INT AS pair_count, count(*) AS lines, 0::BIGINT AS missing, sum(length(text))::BIGINT AS chars, CASE WHEN pair_count > 1 THEN (SELECT count(*) FROM chunks c WHERE c.pair_count = a.pair_count) END AS planned FROM a GROUP BY pair_count""",
        "lexicon_file": f"WITH {lexicon} SELECT word, valence, arousal FROM lx",
        "lexicon_hits": f"WITH {lexicon}, w AS (SELECT doc_id, unnest({words}) AS word FROM documents) SELECT doc_id, count(*) AS hits, round(avg(valence), 6) AS valence, round(avg(arousal), 6) AS arousal FROM w JOIN lx USING (word) GROUP BY doc_id",
        "incremental_run": "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, octet_length(encode(text))::BIGINT AS size FROM documents",
        "event_log": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct, max(ts) AS last FROM events GROUP BY event_type",
        "errors_aside": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad ' || event_id END AS problem FROM events",
        "discovery": "SELECT event_id, false AS reprocess FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, true FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0",
        "file_names": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 < 3 THEN 'talk ' || conv_id END AS name, CASE WHEN conv_id % 4 < 3 THEN strftime(DATE '2024-01-01' + (conv_id % 60)::INT, '%Y-%m-%d') END AS date, CASE WHEN conv_id % 6 + 1 <= 1 THEN 'micro' WHEN conv_id % 6 + 1 <= 3 THEN 'meso' ELSE 'macro' END AS scale FROM conversations",
    }
