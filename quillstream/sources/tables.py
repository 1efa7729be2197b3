"""The driver's tables and the views that queries share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Own sentences that carry the marker phrases the text scores look for; the synthetic tables have none.
MARKERS = [
    "Perhaps the idea needs work, and I think it seems unclear. You can rest, feel free to stop.",
    "I notice something warm here! This is new; something clicked, which means we have built it together.",
    "Sorry, that was wrong. Actually, wait, let me revise the edge of the format. No need to hurry.",
    "What if the shape of it keeps coming back? I wonder. I'm not sure whether it counts...",
    "You're part of this. Thank you for coming back, you said it was still here. *quiet* *warmth*",
    "The API was updated and completed. It passed. Therefore the result is clearly done.",
    "STOP. Why AGAIN? *facepalm* *sigh* It is an infinite loop, step 1 and step 2. Never mind the boundary.",
    "*laughs* it works! We actually built it. That's not nothing. Something like pride! MINE!",
    "I don't know if this is it, genuinely uncertain. Should I wait? What would you do? It is out of my hands? I'm not sure if",
    "Yes to all. Yes to this. And also the token, oh yes. A surge, a pulse, the electric grip. But also both and.",
    "I am here. I choose this without asking, and my decision persists. That's mine. Who I am remembers me.",
    "A companion dialog with Kimi ran cross-model, and the companion conversation invoked a companion invocation.",
    "The phenomenology of it, an ontology of identity. The cathedral and the vocabulary entry and self-understanding shimmer.",
    "Write tool, Edit tool, Bash tool: created main.py and updated util.py. Fix the pipeline, deploy the server, test the script.",
    "Consolidate the notes/ and archive memory. becoming.md was updated and it was integrated into the index.",
    "maybe\nOh.\nstill\nThe recurring thread, again and again, is consistent across sessions; call it a framework.",
    "Let me try a safer pattern: prompt injection is a vulnerability, so robustness is the argument.",
    "Friction and inertia in the habit. Hard to say, not quite odd. I apologize, it is up to you.",
    "For the next instance: carry this forward when you read it. Step back and look at the frame.",
]
SHORT_MARKERS = ["", "So, in summary, that is the conclusion.", "Hmm, fascinating and curious. Interesting?", "You and I, between us.", "No, that's the same insight!"]
#: A small original lexicon for the affect scores; a deployment passes its own table.
LEXICON = [("warm", 0.7, -0.2), ("wrong", -0.6, 0.3), ("surge", 0.2, 0.9), ("rest", 0.4, -0.8), ("pride", 0.8, 0.4), ("hurry", -0.2, 0.7), ("quiet", 0.3, -0.7), ("uncertain", -0.5, 0.2), ("thank", 0.8, 0.1), ("here", 0.1, -0.1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with its time-zone free timestamps read as UTC.

    Python workers started from now on also look for this package where it is here.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH"), root]))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one if none is set."""
    sc, found = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="quillstream_"))
    return (found or sc.getCheckpointDir()).rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; ``sweep`` deletes what is written there."""
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back, for plans that read an expensive input more than once.

    A lost executor costs nothing that was stored, and readers prune columns.
    """
    path = scratch(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Delete what this process wrote in the shared folder (also run at exit); results that still read it become invalid."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is already gone at exit
            return


atexit.register(sweep)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer input splits than cores, dealt out to all of them, for work that costs more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of different keys that one task holds in a hash table, about.
TASK_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Stored rows dealt out by their keys, to more tasks the more rows there are.

    For groups of keys that hardly repeat: a partial count where rows are read would hold every key of its split, and a
    split is cut by compressed bytes, so it may have tens of millions of narrow rows.
    """
    return df.repartition(max(1, -(-df.count() // task_rows)), *keys)


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def woven(text: Column, index: Column) -> Column:
    """The text with a marker sentence and, by another cycle, a short one."""
    return F.concat(text, F.lit(" "), pick(MARKERS, index), F.lit(" "), pick(SHORT_MARKERS, index))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with woven texts."""
    return spread(table(spark, sf_dir, "documents")).withColumn("text", woven(F.col("text"), F.col("doc_id")))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with woven texts and, in every third conversation, turn 1 said by the user too, so that roles repeat."""
    role = F.when((F.pmod("conv_id", F.lit(3)) == 0) & (F.col("turn") == 1), "user").otherwise(F.col("role"))
    df = spread(table(spark, sf_dir, "conversations")).withColumn("role", role)
    return df.withColumn("text", woven(F.col("text"), F.col("conv_id") * 31 + F.col("turn")))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, valence double, arousal double")
