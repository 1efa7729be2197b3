"""Queries over notes as a memory: references, triggers, packing, topics, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relate, retrieval
from ..sources.tables import notes, table
from . import duck

DOCUMENT = "Index: note_12.md, NOTE_40 and what was written on 2024-01-17; see note_7 too."
KEYWORDS = {
    "building": ["pipeline", "deploy", "server", "script"], "identity": ["identity", "who i am", "persist"], "feeling": ["warm", "quiet", "pride"],
    "safety": ["injection", "vulnerability", "robust"], "memory": ["archive", "notes/", "remember"],
}
TODAY = "2024-03-01"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as note files: name, date (not all), length in lines, first line, token estimate."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.concat(F.lit("note_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(F.pmod("doc_id", F.lit(3)) > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(80)).cast("int")).cast("string")).alias("date"),
        F.size(F.split(text, "\n")).alias("lines"), F.trim(F.split(text, "\n")[0]).alias("first_line"), F.floor(F.char_length(text) / 4).alias("tokens"),
    )


def q_notes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "date", "lines", F.md5("first_line").alias("first"), "tokens")


def q_unreferenced_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = spark.createDataFrame([(DOCUMENT,)], "text string")
    aged = files(spark, sf_dir).where(F.col("date").isNull() | (F.to_date("date") <= F.date_sub(F.lit(TODAY).cast("date"), 3)))
    return relate.unreferenced(aged, document).select("path")


def q_new_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = files(spark, sf_dir).withColumn("digest", F.concat_ws(":", "path", "lines"))
    return relate.new_rows(hashed, hashed.where("doc_id % 4 = 1").select("digest"), "digest").select("path")


def q_trigger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = files(spark, sf_dir).groupBy("source").agg(F.count("*").alias("notes"), F.sum("tokens").alias("tokens"), F.min("date").alias("oldest"))
    age = F.datediff(F.lit(TODAY).cast("date"), F.to_date("oldest"))
    rules = {
        "notes": (F.col("notes") >= 51, F.concat(F.col("notes").cast("string"), F.lit(" new notes"))),
        "size": (F.col("tokens") >= 31000, F.concat(F.lit("size "), F.col("tokens").cast("string"))),
        "age": (age >= 60, F.concat(F.lit("oldest entry is "), age.cast("string"), F.lit(" days old"))),
    }
    return relate.triggers(facts, rules).select("source", "notes", "tokens", "triggered", "reasons")


def q_inbox_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("item_"), F.col("page_id").cast("string")).alias("filename"), "page_id")
    state = pages.where("page_id % 3 <> 0").select(
        "filename", F.when(F.pmod("page_id", F.lit(2)) == 0, "considering").otherwise("done").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(20)).cast("int")).alias("discovered")
    )
    return relate.sync(pages.where("page_id % 7 <> 0"), state, "filename", F.lit(TODAY).cast("date"))


def q_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = files(spark, sf_dir)
    return relate.packed(items, "source", [F.col("date").asc_nulls_last(), F.col("doc_id")], "tokens", 8000).select("doc_id", "used")


def q_topic_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes(spark, sf_dir).select("doc_id", retrieval.categories(F.col("text"), KEYWORDS).alias("c"))
    return found.select("doc_id", F.array_join("c", ",").alias("categories"))


def q_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" PER-"), (F.pmod("doc_id", F.lit(90)) + 10).cast("string"), F.lit(" and AB-7, AB-7"))
    df = notes(spark, sf_dir).withColumn("text", text)
    return df.select("doc_id", F.array_join(retrieval.file_refs(F.col("text")), ",").alias("files"), F.array_join(retrieval.issue_refs(F.col("text")), ",").alias("issues"))


def q_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.concat(F.lit("q"), F.pmod("user_id", F.lit(97)).cast("string")).alias("query"), F.pmod("event_id", F.lit(400)).alias("pulse"))
    return retrieval.suppression(offers, "query", "pulse", 399)


def q_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = notes(spark, sf_dir)
    origin = lambda name, column: base.select("doc_id", F.lit(name).alias("origin"), F.posexplode(column).alias("position", "query"))
    low = F.lower("text")
    words = F.slice(F.filter(F.split(low, r"[^a-z]+"), lambda w: F.length(w) > 5), 1, 4)
    feelings = F.filter(F.array(F.when(F.contains(low, F.lit("warm")), "feeling warm"), F.when(F.contains(low, F.lit("pride")), "feeling proud")), lambda x: x.isNotNull())
    candidates = origin("instructions", words).unionByName(origin("feeling", feelings)).unionByName(origin("category", retrieval.categories(F.col("text"), KEYWORDS)))
    return retrieval.query_plan(candidates, "doc_id", 6).select("doc_id", "query", "origin", "min_score", F.col("place").cast("int"))


def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", 5)
    return found.select("item_id", "doc_id", "score", F.col("rank").cast("int"))


def q_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = retrieval.bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", 10)
    return retrieval.pointers(results, "item_id", "doc_id", F.lit(40.0))


def q_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.hint(F.col("text")))


def q_response_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a response under the headers that name integration, archiving or staleness."""
    text = F.concat(F.lit("intro\n## To integrate\n"), F.col("text"), F.lit("\n# Archive these\nold\n### Stale entries\nmore\n## Other\nx"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    head = F.when(F.col("line").startswith("#"), F.lower("line"))
    name = F.when(F.contains(head, F.lit("integrat")), "integrate").when(F.contains(head, F.lit("archiv")), "archive").when(F.contains(head, F.lit("stale")), "stale")
    section = F.last(F.when(name.isNotNull(), name), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("i"))
    inside = lines.withColumn("section", section).where("NOT startswith(line, '#') AND section IS NOT NULL")
    return inside.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def oracles() -> dict[str, str]:
    f = "files AS (SELECT doc_id, source, 'note_' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 > 0 THEN strftime(DATE '2024-01-01' + (doc_id % 80)::INT, '%Y-%m-%d') END AS date, len(string_split(text, chr(10)))::INT AS lines, trim(string_split(text, chr(10))[1]) AS first_line, (length(text) // 4)::BIGINT AS tokens FROM documents)"
    cats = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), {duck.lit(w)})" for w in ws) + f" THEN '{n}' END" for n, ws in KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"
    age = f"date_diff('day', min(date)::DATE, DATE '{TODAY}')"
    tok = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'), lambda w: w <> '')"
    bm = f"""d AS (SELECT doc_id, {tok('text')} AS ts FROM documents), q AS (SELECT DISTINCT item_id, unnest({tok('text')}) AS token FROM benchmark), u AS (SELECT doc_id, len(ts) AS size, unnest(ts) AS token FROM d),
i AS (SELECT token, doc_id, any_value(size) AS size, count(*) AS tf FROM u WHERE token IN (SELECT token FROM q) GROUP BY token, doc_id), n AS (SELECT count(*) AS docs, avg(len(ts)) AS mean FROM d), df AS (SELECT token, count(*) AS df FROM i GROUP BY token),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM i JOIN df USING (token) JOIN q USING (token), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)"""
    words = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 5)[1:4]"
    feel = "list_filter([CASE WHEN contains(lower(text), 'warm') THEN 'feeling warm' END, CASE WHEN contains(lower(text), 'pride') THEN 'feeling proud' END], lambda x: x IS NOT NULL)"
    text = "text || ' PER-' || (doc_id % 90 + 10) || ' and AB-7, AB-7'"
    lines = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 10 AND NOT starts_with(x, '#') AND NOT starts_with(x, '---'))[1]"
    response = "'intro' || chr(10) || '## To integrate' || chr(10) || text || chr(10) || '# Archive these' || chr(10) || 'old' || chr(10) || '### Stale entries' || chr(10) || 'more' || chr(10) || '## Other' || chr(10) || 'x'"
    low = DOCUMENT.lower()
    return {
        "notes_scan": f"WITH {f} SELECT path, date, lines, md5(first_line) AS first, tokens FROM files",
        "unreferenced_notes": f"WITH {f} SELECT path FROM files WHERE (date IS NULL OR date::DATE <= DATE '{TODAY}' - 3) AND NOT contains({duck.lit(low)}, replace(path, '.md', '')) AND NOT contains({duck.lit(low)}, path) AND NOT coalesce(contains({duck.lit(DOCUMENT)}, date), false)",
        "new_notes": f"WITH {f} SELECT path FROM files WHERE doc_id % 4 <> 1",
        "trigger_status": f"WITH {f}, a AS (SELECT source, count(*) AS notes, sum(tokens)::BIGINT AS tokens, {age} AS age FROM files GROUP BY source) SELECT source, notes, tokens, notes >= 51 OR tokens >= 31000 OR coalesce(age >= 60, false) AS triggered, concat_ws('; ', CASE WHEN notes >= 51 THEN notes || ' new notes' END, CASE WHEN tokens >= 31000 THEN 'size ' || tokens END, CASE WHEN age >= 60 THEN 'oldest entry is ' || age || ' days old' END) AS reasons FROM a",
        "inbox_sync": f"SELECT 'item_' || page_id AS filename, CASE WHEN page_id % 3 = 0 THEN 'fresh' WHEN page_id % 2 = 0 THEN 'considering' ELSE 'done' END AS status, CASE WHEN page_id % 3 = 0 THEN DATE '{TODAY}' ELSE DATE '2024-01-01' + (page_id % 20)::INT END AS discovered, DATE '{TODAY}' AS last_seen FROM pages WHERE page_id % 7 <> 0",
        "context_pack": f"WITH {f}, u AS (SELECT doc_id, sum(tokens) OVER (PARTITION BY source ORDER BY date NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM files) SELECT doc_id, used FROM u WHERE used < 7000",
        "topic_categories": f"WITH {duck.NOTES} SELECT doc_id, coalesce(array_to_string({cats}, ','), '') AS categories FROM notes",
        "refs": f"WITH {duck.NOTES}, x AS (SELECT doc_id, {text} AS text FROM notes) SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b([\\w/-]+\\.(?:py|md|json|yaml|ts))\\b', 1))), ','), '') AS files, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b([A-Z]{{2,5}}-\\d+)\\b', 1))), ','), '') AS issues FROM x",
        "suppression": "WITH o AS (SELECT 'q' || (user_id % 97) AS query, max(event_id % 400) AS last, count(*) AS offered FROM events WHERE event_type = 'click' GROUP BY 1) SELECT query, offered, round(0.85::DOUBLE ** (399 - last), 6) AS weight, round(0.85::DOUBLE ** (399 - last), 6) >= 0.4 AS suppressed FROM o WHERE round(0.85::DOUBLE ** (399 - last), 6) >= 0.05",
        "query_plan": f"""WITH {duck.NOTES}, c AS (SELECT doc_id, 0 AS o, 'instructions' AS origin, unnest({words}) AS query, generate_subscripts({words}, 1) AS position FROM notes UNION ALL SELECT doc_id, 1, 'feeling', unnest({feel}), generate_subscripts({feel}, 1) FROM notes UNION ALL SELECT doc_id, 2, 'category', unnest({cats}), generate_subscripts({cats}, 1) FROM notes),
m AS (SELECT doc_id, query, min((o, position, origin)) AS m FROM c GROUP BY doc_id, query), p AS (SELECT doc_id, query, m[3] AS origin, CASE WHEN m[1] = 2 THEN 5.0 ELSE 2.0 END::DOUBLE AS min_score, row_number() OVER (PARTITION BY doc_id ORDER BY m[1], m[2], query)::INT AS place FROM m) SELECT * FROM p WHERE place <= 6""",
        "bm25_topk": f"WITH {bm} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5",
        "pointers": f"WITH {bm} SELECT item_id, arg_max(doc_id, (score, -doc_id)) AS top, max(score) AS score, count(*) AS n FROM r WHERE rank <= 10 AND score >= 40 GROUP BY item_id ORDER BY score DESC, item_id LIMIT 4",
        "hints": f"WITH h AS (SELECT doc_id, {lines} AS line FROM documents) SELECT doc_id, CASE WHEN length(line) <= 100 THEN line ELSE regexp_replace(substr(line, 1, 100), '\\s+\\S*$', '') END AS hint FROM h",
        "response_sections": f"""WITH l AS (SELECT doc_id, unnest(string_split({response}, chr(10))) AS line, generate_subscripts(string_split({response}, chr(10)), 1) AS i FROM documents),
s AS (SELECT *, last_value(CASE WHEN starts_with(line, '#') THEN CASE WHEN contains(lower(line), 'integrat') THEN 'integrate' WHEN contains(lower(line), 'archiv') THEN 'archive' WHEN contains(lower(line), 'stale') THEN 'stale' END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM s WHERE NOT starts_with(line, '#') AND section IS NOT NULL GROUP BY doc_id, section""",
    }
