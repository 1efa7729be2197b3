"""Queries over parsed transcripts and over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parsers, udtf
from ..sources import transcripts
from ..sources.tables import scratch, table
from ..streaming import windows
from . import duck, ledger

PIECES = ["=== Human ===", "hello", "<thinking>", "quiet", "</thinking>", "**Claude**: well", "=== C ===", "<thinking>one line</thinking>", "", "User: ask", "=== System ===", "rules", "=== Other ===", "A: yes", "=== H ==="]


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with speaker lines, chosen by the number of the document, before and after the lines of the text."""
    pick = lambda k: F.element_at(F.array(*[F.lit(p) for p in PIECES]), (F.pmod(F.col("doc_id") * k + F.lit(k * k), F.lit(len(PIECES))) + 1).cast("int"))
    parts = [pick(1), pick(2), F.col("text"), pick(4), pick(7), F.lit("mid"), pick(8), pick(11), F.lit("end"), pick(13)]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("text"))


def q_md_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsers.markdown_segments(_markdown(spark, sf_dir), "doc_id")
    return found.select("doc_id", "line_start", "line_end", "speaker", "content_type", F.md5("content").alias("digest"))


def q_md_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsers.markdown_segments(_markdown(spark, sf_dir), "doc_id", thinking=False)
    return found.select("doc_id", "line_start", "speaker", F.md5("content").alias("digest"))


def q_udtf_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the same texts by the table function, called from SQL."""
    lines = _markdown(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    found = udtf.registered(spark).sql("SELECT * FROM segments(TABLE({lines}) PARTITION BY doc_id ORDER BY number)", lines=lines)
    return found.select("doc_id", "line_start", "line_end", "speaker", "content_type", F.md5("content").alias("digest"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of one file a turn, of every format."""
    kind = F.pmod("conv_id", F.lit(4))
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), 6, 1 << 30)
    turn = F.when(kind == 1, F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), quoted(F.col("text")))).when(kind == 2, F.concat(F.lit("<p>=== Human ===</p><p>\n</p><b>"), F.regexp_replace("text", "\n", "<br>"), F.lit("</b>"))).otherwise(F.concat(F.lit("=== Human ===\n"), "text"))
    suffix = F.element_at(F.array(F.lit("md"), F.lit("JSONL"), F.lit("html"), F.lit("unknown")), (kind + 1).cast("int"))
    first = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return first.select(F.concat(F.lit("dir/f"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit("."), suffix).alias("path"), turn.alias("text"))


def digests(segments: DataFrame) -> DataFrame:
    return segments.select("path", "place", "speaker", "content_type", F.md5(F.regexp_replace("content", r"\s+", " ")).alias("digest"))


def q_all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every format in one table: the suffix decides how each is read."""
    return digests(parsers.parsed(formats(spark, sf_dir)))


def q_transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files written one by one into folders and read through the data source."""
    root = scratch(spark, "transcripts")
    transcripts.written(formats(spark, sf_dir), root)
    return digests(transcripts.segments(transcripts.registered(spark).read.format(transcripts.NAME).load(root)))


def q_jsonl_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, role = F.col("text"), F.col("role")
    block = lambda kind, name, value: F.to_json(F.struct(F.lit(kind).alias("type"), value.alias(name)))
    quoted = lambda v: F.to_json(F.struct(v.alias("x")))
    field = lambda v: F.substring(quoted(v), 6, 1 << 30)
    line = (
        F.when(F.pmod("turn", F.lit(4)) == 0, F.concat(F.lit('{"type":"message","sender":"'), role, F.lit('","content":['), block("thinking", "thinking", F.lit("hm")), F.lit(","), block("text", "text", t), F.lit("]}")))
        .when(F.pmod("turn", F.lit(4)) == 1, F.concat(F.lit('{"role":"Claude","content":'), field(t)))
        .when(F.pmod("turn", F.lit(4)) == 2, F.concat(F.lit('{"from":"bot","text":'), field(t)))
        .when(F.pmod("conv_id", F.lit(2)) == 0, F.lit("{broken"))
        .otherwise(F.lit('{"type":"meta","note":1}'))
    )
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    found = parsers.jsonl_segments(lines, ["conv_id", "turn"])
    return found.select("conv_id", "turn", "block", "speaker", "content_type", F.md5("content").alias("digest"))


def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(parsers.html_text(F.col("html"))).alias("digest"), F.md5(parsers.html_text(F.col("html"), True)).alias("without_script"))


def q_label_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, human, assistant = parsers.migrated_labels(F.concat(F.lit("=== Human ===\n"), F.col("text"), F.lit("\n=== Assistant ===\n=== Human === no\n=== Human ===")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(changed).alias("digest"), human.cast("long").alias("humans"), assistant.cast("long").alias("assistants"))


def q_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.tumbling(windows.event_stream(spark, sf_dir), "1 hour"), scratch(spark, "stream"), "complete")


def q_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.sliding(windows.event_stream(spark, sf_dir), "1 hour", "30 minutes"), scratch(spark, "stream"), "complete")


def q_stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.drained(windows.sessions(windows.event_stream(spark, sf_dir), "2 hours"), scratch(spark, "stream"), "complete")


def q_stream_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state store that the processor needs is set for this query alone."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, windows.ROCKSDB)
    try:
        return windows.drained(windows.decayed_peaks(windows.event_stream(spark, sf_dir)), scratch(spark, "stream"), "append")
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def oracles() -> dict[str, str]:
    pick = lambda k: f"({duck.array(PIECES)})[((doc_id * {k} + {k * k}) % {len(PIECES)} + 1)::BIGINT]"
    parts = [pick(1), pick(2), "text", pick(4), pick(7), "'mid'", pick(8), pick(11), "'end'", pick(13)]
    human, claude = parsers.INLINE_HUMAN, parsers.INLINE_ASSISTANT
    md = f"""t AS (SELECT doc_id, {' || chr(10) || '.join(parts)} AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS i FROM t),
h AS (SELECT *, CASE WHEN regexp_matches(line, {duck.lit(parsers.HEADER)}) THEN lower(regexp_extract(line, {duck.lit(parsers.HEADER)}, 1)) END AS raw FROM l),
m AS (SELECT doc_id, line, i, CASE WHEN raw IN ('human', 'w', 'h') THEN 'human' WHEN raw IN ('assistant', 'c') THEN 'assistant' WHEN raw = 'system' THEN 'system' END AS head,
  CASE WHEN raw IS NULL THEN CASE WHEN regexp_matches(line, {duck.lit(human)}) THEN 'human' WHEN regexp_matches(line, {duck.lit(claude)}) THEN 'assistant' END END AS inl FROM h),
s AS (SELECT *, last_value(coalesce(head, inl) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS speaker FROM m),
e AS (SELECT *, CASE WHEN head IS NOT NULL THEN 0 WHEN contains(lower(line), '<thinking>') AND speaker IS NOT NULL THEN 1 WHEN contains(lower(line), '</thinking>') THEN 0 END AS ev FROM s),
a AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 0) AS aft FROM e), b AS (SELECT *, coalesce(lag(aft) OVER (PARTITION BY doc_id ORDER BY i), 0) AS bef FROM a),
c AS (SELECT *, coalesce(ev = 1 AND bef = 0, false) AS opens, coalesce(lag(bef = 1 AND coalesce(ev = 0, false) AND head IS NULL) OVER (PARTITION BY doc_id ORDER BY i), false) AS ended FROM b),
g AS (SELECT *, sum((head IS NOT NULL OR inl IS NOT NULL OR opens OR ended)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM c),
r AS (SELECT *, CASE WHEN inl = 'human' THEN regexp_extract(line, {duck.lit(human)}, 1) WHEN inl = 'assistant' THEN regexp_extract(line, {duck.lit(claude)}, 1) ELSE line END AS content FROM g WHERE speaker IS NOT NULL),
k AS (SELECT doc_id, seg, min(i) FILTER (head IS NULL) AS line_start, max(i) AS line_end, arg_min(speaker, i) AS speaker, arg_min(opens, i) AS opens, {duck.stripped('array_to_string(list(content ORDER BY i) FILTER (head IS NULL), chr(10))')} AS content FROM r GROUP BY doc_id, seg),
f AS (SELECT doc_id, line_start, line_end, speaker, CASE WHEN opens THEN 'thinking' ELSE 'text' END AS content_type, content FROM k WHERE content <> ''),
u AS (SELECT * FROM f UNION ALL SELECT doc_id, 0, len(string_split(text, chr(10))) - 1, 'unknown', 'text', text FROM t WHERE doc_id NOT IN (SELECT doc_id FROM f))"""
    role = "CASE role WHEN 'user' THEN 'human' ELSE role END"
    again = ledger.oracles()
    raw = "(?s)<style>.*?</style>", "(?s)<script>.*?</script>"
    inner = lambda t: f"regexp_extract(html, '(?s)<{t}>(.*?)</{t}>', 1)"
    plain = lambda x: f"replace(replace(replace(replace({x}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    cut = f"regexp_replace(regexp_replace(regexp_replace(html, {duck.lit(raw[0])}, chr(3) || chr(1) || chr(3), 'g'), {duck.lit(raw[1])}, chr(3) || chr(2) || chr(3), 'g'), '(?s)(<!--.*?-->|<[!/?a-zA-Z][^>]*>)+', chr(3), 'g')"
    nodes = f"list_transform(string_split({cut}, chr(3)), lambda x: CASE x WHEN chr(1) THEN {inner('style')} WHEN chr(2) THEN {inner('script')} ELSE {plain('x')} END)"
    told = lambda xs: f"md5(coalesce(array_to_string(list_filter({xs}, lambda x: x <> ''), ' '), ''))"
    peak = lambda last: duck.r3(f"greatest(coalesce(value, 0), {last} * 0.85)")
    flat = lambda c: f"md5(regexp_replace({c}, '\\s+', ' ', 'g'))"
    found = {
        "md_segments": f"WITH {md} SELECT doc_id, line_start::INT AS line_start, line_end::INT AS line_end, speaker, content_type, md5(content) AS digest FROM u",
        "jsonl_segments": f"""SELECT conv_id, turn, 0 AS block, {role} AS speaker, 'thinking' AS content_type, md5('hm') AS digest FROM conversations WHERE turn % 4 = 0
UNION ALL SELECT conv_id, turn, 1, {role}, 'text', md5(text) FROM conversations WHERE turn % 4 = 0 UNION ALL SELECT conv_id, turn, 0, 'assistant', 'text', md5(text) FROM conversations WHERE turn % 4 IN (1, 2)""",
        "label_migration": "SELECT doc_id, md5('=== H ===' || chr(10) || text || chr(10) || '=== C ===' || chr(10) || '=== Human === no' || chr(10) || '=== H ===') AS digest, 2::BIGINT AS humans, 1::BIGINT AS assistants FROM documents",
        "md_spoken": f"WITH {md} SELECT doc_id, line_start::INT AS line_start, speaker, md5(content) AS digest FROM u WHERE content_type <> 'thinking'",
        "all_formats": f"""WITH f AS (SELECT *, conv_id % 4 AS k, 'dir/f' || conv_id || '_' || turn || '.' AS p FROM conversations WHERE role <> 'system')
SELECT p || CASE k WHEN 0 THEN 'md' ELSE 'unknown' END AS path, 1::BIGINT AS place, 'human' AS speaker, 'text' AS content_type, {flat(duck.stripped('text'))} AS digest FROM f WHERE k IN (0, 3) AND {duck.stripped('text')} <> ''
UNION ALL SELECT p || 'JSONL', 0, CASE role WHEN 'user' THEN 'human' ELSE role END, 'text', {flat('text')} FROM f WHERE k = 1
UNION ALL SELECT p || 'html', 1, 'human', 'text', {flat(duck.stripped("array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ')"))} FROM f WHERE k = 2""",
        "html_text": f"WITH n AS (SELECT page_id, {nodes} AS xs, list_filter(string_split({cut}, chr(3)), lambda x: x NOT IN (chr(1), chr(2))) AS ys FROM pages) SELECT page_id, {told('xs')} AS digest, {told(f'list_transform(ys, lambda x: {plain(chr(120))})')} AS without_script FROM n",
        "stream_decay": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, {peak('0')}::DOUBLE AS peak FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, {peak('f.peak').replace('value', 'e.value')}::DOUBLE FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT user_id, event_id, peak FROM f""",
        "stream_tumbling": again["tumbling_windows"],
        "stream_sliding": again["sliding_windows"],
        "stream_session": again["session_windows"],
    }
    found["transcript_files"], found["udtf_segments"] = found["all_formats"], found["md_segments"]
    return found
