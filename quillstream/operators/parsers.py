"""Transcripts in Markdown, JSON lines, HTML and plain text as rows of segments."""

from __future__ import annotations

from html.entities import name2codepoint
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

# Speaker headers and the inline forms that also start a turn.
HEADER = r"(?i)^===\s*(human|assistant|system|w|h|c)\s*===\s*$"
INLINE_HUMAN, INLINE_ASSISTANT = r"(?i)^(?:(?:human|user|h):|\*\*(?:human|user)\*\*:)\s*(.*)$", r"(?i)^(?:(?:assistant|claude|a):|\*\*(?:assistant|claude)\*\*:)\s*(.*)$"
SUFFIXES = {"md": "markdown", "markdown": "markdown", "jsonl": "jsonl", "json": "jsonl", "html": "html", "htm": "html", "txt": "txt"}
#: Named character references, as HTML 4 has them and ``apos``.
ENTITIES = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
PIECES = r"&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]{1,5};|&#[xX][0-9a-fA-F]{1,4};|[^&]+|&"


def markdown_segments(docs: DataFrame, key: str, text: str = "text", thinking: bool = True) -> DataFrame:
    """(key, line_start, line_end, speaker, content_type, content) of every document.

    A header or inline label starts a segment, and so do the opening line of a <thinking> block and the line after its
    end. Lines before any speaker belong to none; a document without segments is one of speaker ``unknown``. All windows
    run over one document's lines, in one shuffle.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    head = F.lower(F.nullif(F.regexp_extract("line", HEADER, 1), F.lit("")))
    by_head = F.when(head.isin("human", "w", "h"), "human").when(head.isin("assistant", "c"), "assistant").when(head == "system", "system")
    inline = F.when(F.col("line").rlike(INLINE_HUMAN), "human").when(F.col("line").rlike(INLINE_ASSISTANT), "assistant")
    w = Window.partitionBy(key).orderBy("i")
    marked = lines.withColumn("head", by_head).withColumn("inline", F.when(F.col("head").isNull(), inline))
    marked = marked.withColumn("speaker", F.last(F.coalesce("head", "inline"), ignorenulls=True).over(w))
    low = F.lower("line")
    event = F.when(F.col("head").isNotNull(), 0).when(F.contains(low, F.lit("<thinking>")) & F.col("speaker").isNotNull(), 1).when(F.contains(low, F.lit("</thinking>")), 0)
    marked = marked.withColumn("event", event).withColumn("after", F.coalesce(F.last("event", ignorenulls=True).over(w), F.lit(0)))
    marked = marked.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)))
    opens = (F.col("event") == 1) & (F.col("before") == 0)
    ended = F.coalesce(F.lag((F.col("before") == 1) & (F.col("event") == 0) & F.col("head").isNull()).over(w), F.lit(False))
    starts = F.col("head").isNotNull() | F.col("inline").isNotNull() | F.coalesce(opens, F.lit(False)) | ended
    marked = marked.withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("segment", F.sum(starts.cast("int")).over(w))
    labelled = F.when(F.col("speaker") == "human", F.regexp_extract("line", INLINE_HUMAN, 1)).otherwise(F.regexp_extract("line", INLINE_ASSISTANT, 1))
    content = F.when(F.col("inline").isNotNull(), labelled).otherwise(F.col("line"))
    rows = marked.where("speaker IS NOT NULL").withColumn("content", content)
    grouped = rows.groupBy(key, "segment").agg(
        F.min(F.when(F.col("head").isNull(), F.col("i"))).alias("line_start"), F.max("i").alias("line_end"), F.min_by("speaker", "i").alias("speaker"),
        F.min_by("opens", "i").alias("opens"),
        F.sort_array(F.collect_list(F.when(F.col("head").isNull(), F.struct("i", "content")))).alias("_l"),
    )
    joined = grouped.withColumn("content", stripped(F.array_join(F.transform("_l", lambda x: x["content"]), "\n"))).where("content <> ''")
    kind = F.when(F.col("opens"), "thinking").otherwise("text")
    found = joined.select(key, "line_start", "line_end", "speaker", kind.alias("content_type"), "content")
    whole = docs.join(found.select(key).distinct(), key, "left_anti").select(
        key, F.lit(0).alias("line_start"), (F.size(F.split(text, "\n")) - 1).alias("line_end"), F.lit("unknown").alias("speaker"), F.lit("text").alias("content_type"), F.col(text).alias("content")
    )
    every = found.unionByName(whole)
    return every if thinking else every.where("content_type <> 'thinking'")


def jsonl_segments(lines: DataFrame, key: list[str], line: str = "line", thinking: bool = True) -> DataFrame:
    """(key, block, speaker, content_type, content) of JSON message lines; malformed lines and other objects are skipped."""
    get = lambda path: F.get_json_object(line, path)
    valid = F.try_parse_json(line).isNotNull()
    message = F.coalesce(get("$.type") == "message", F.lit(False)) | get("$.content").isNotNull() | get("$.text").isNotNull()
    who = F.lower(F.coalesce(F.nullif(get("$.sender"), F.lit("")), F.nullif(get("$.role"), F.lit("")), F.nullif(get("$.from"), F.lit("")), F.lit("unknown")))
    speaker = F.when(who == "user", "human").when(who.isin("claude", "ai", "bot"), "assistant").otherwise(who)
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), "$.content", "variant")).startswith("ARRAY"), F.lit(False))
    blocks = F.when(listed, F.from_json(get("$.content"), "array<string>")).otherwise(F.array(F.coalesce(get("$.content"), get("$.text"))))
    rows = lines.where(valid & message).select(*key, speaker.alias("speaker"), listed.alias("_listed"), F.posexplode(blocks).alias("block", "_b"))
    inside = F.col("_listed") & F.col("_b").startswith("{")
    of = lambda path: F.nullif(F.get_json_object("_b", path), F.lit(""))
    content = F.when(inside, F.coalesce(of("$.text"), of("$.thinking"), of("$.content"))).otherwise(F.col("_b"))
    kind = F.when(inside, F.coalesce(F.get_json_object("_b", "$.type"), F.lit("text"))).otherwise("text")
    found = rows.select(*key, "block", "speaker", kind.alias("content_type"), content.alias("content")).where("content IS NOT NULL")
    return found if thinking else found.where("content_type <> 'thinking'")


def unescaped(text: Column) -> Column:
    """Character references replaced: the named ones of HTML 4 and numbers of the basic plane; others stay."""
    names = F.create_map(*[F.lit(x) for x in chain(*ENTITIES.items())])
    number = lambda t: F.when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(t, "([0-9]+)", 1))
    char = lambda t: F.decode(F.unhex(F.lpad(F.hex(number(t).cast("long")), 4, "0")), "UTF-16BE")
    piece = lambda t: F.when(~t.startswith("&"), t).when(t.startswith("&#"), char(t)).otherwise(F.coalesce(F.try_element_at(names, t), t))
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), piece), ""))


def html_text(html: Column, drop_script: bool = False) -> Column:
    """Text nodes joined by single spaces. Scripts and styles are text too unless dropped; tags in them are not tags."""
    parts = F.split(html, r"(?is)(?=<(?:script|style)\b)|(?<=</script>)|(?<=</style>)")
    raw = lambda p: p.rlike(r"(?is)^<(?:script|style)\b")

    def nodes(p: Column) -> Column:
        inner = F.regexp_extract(p, r"(?is)^<\w+[^>]*>(.*?)(?:</\w+>)?$", 1)
        plain = F.transform(F.split(p, r"(?s)(?:<!--.*?-->|<[!/?a-zA-Z][^>]*>)+"), unescaped)
        return F.filter(F.when(raw(p), F.array(inner)).otherwise(plain), lambda x: x != "")

    kept = F.filter(parts, lambda p: ~raw(p)) if drop_script else parts
    return F.array_join(F.flatten(F.transform(kept, nodes)), " ")


def format_of(path: Column) -> Column:
    """Format by suffix; Markdown if unknown."""
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit("markdown")
    for name, kind in SUFFIXES.items():
        out = F.when(suffix == name, kind).otherwise(out)
    return out


def migrated_labels(text: Column) -> tuple[Column, Column, Column]:
    """The text with long speaker headers shortened, and how many of each kind there were."""
    human, assistant = r"(?m)^=== Human ===$", r"(?m)^=== Assistant ===$"
    changed = F.regexp_replace(F.regexp_replace(text, human, "=== H ==="), assistant, "=== C ===")
    return changed, F.regexp_count(text, F.lit(human)), F.regexp_count(text, F.lit(assistant))


def parsed(files: DataFrame, path: str = "path", text: str = "text", thinking: bool = True) -> DataFrame:
    """(path, place, speaker, content_type, content) of the segments of files of any format, by the suffix of the path.

    place orders the segments of a file: the first line in texts, a hundred times the line plus the block in JSON lines.
    """
    known = files.select(F.col(path).alias("path"), F.col(text).alias("text"), format_of(F.col(path)).alias("_f"))
    texts = known.where("_f <> 'jsonl'").select("path", F.when(F.col("_f") == "html", html_text(F.col("text"))).otherwise(F.col("text")).alias("text"))
    segments = markdown_segments(texts, "path", thinking=thinking).select("path", F.col("line_start").alias("place"), "speaker", "content_type", "content")
    lines = known.where("_f = 'jsonl'").select("path", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    messages = jsonl_segments(lines, ["path", "number"], thinking=thinking).select("path", (F.col("number") * 100 + F.col("block")).alias("place"), "speaker", "content_type", "content")
    return segments.unionByName(messages)
