"""Table functions for SQL: ``segments`` of Markdown transcripts, fed line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, StringType, StructType

from .parsers import HEADER, INLINE_ASSISTANT, INLINE_HUMAN

NAME = "segments"
#: The ends of lines that Java's patterns know, which its dot leaves out.
ENDS = "\n\r\x85\u2028\u2029"


def as_java(pattern: str) -> re.Pattern:
    """A pattern of ``parsers`` for Python's engine, with the classes of Java's: ASCII, and no line end in a dot."""
    return re.compile(pattern.replace("(.*)$", f"([^{ENDS}]*)[{ENDS}]?$"), re.ASCII)


HEAD, HUMAN, ASSISTANT = as_java(HEADER), as_java(INLINE_HUMAN), as_java(INLINE_ASSISTANT)
SPEAKERS = {"human": "human", "w": "human", "h": "human", "assistant": "assistant", "c": "assistant", "system": "system"}


class Segments:
    """``segments(TABLE(lines) PARTITION BY key ORDER BY number, thinking => true)``.

    The table has a key, the number of a line and the line, in this order, and any further columns. Returns key,
    line_start, line_end, speaker, content_type and content, as ``parsers.markdown_segments`` does: one document at a
    time, of which the open segment is held, and the lines so far as long as no segment has come.
    """

    def __init__(self) -> None:
        self.key, self.thinking = None, True
        self.speaker, self.inside, self.closed = None, False, False
        self.first, self.last, self.owner, self.opened, self.lines = None, None, None, False, []
        self.any, self.all, self.last_line = False, [], None

    @staticmethod
    def analyze(lines: AnalyzeArgument, thinking: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not lines.isTable or len(lines.dataType.fields) < 3:
            raise ValueError("segments take a table of a key, the number of a line and the line")
        if thinking is not None and not (thinking.isConstantExpression and isinstance(thinking.value, bool)):
            raise ValueError("thinking is true or false")
        key = lines.dataType.fields[0]
        schema = StructType().add(key.name, key.dataType).add("line_start", IntegerType()).add("line_end", IntegerType())
        return AnalyzeResult(schema.add("speaker", StringType()).add("content_type", StringType()).add("content", StringType()))

    def eval(self, lines: Row, thinking: bool = True) -> Iterator[tuple]:
        self.key, number, line = lines[0], lines[1], lines[2]
        self.thinking, self.last_line = thinking, number
        if line is None:
            return
        if not self.any:
            self.all.append(line)
        head = HEAD.match(line)
        name = SPEAKERS[head.group(1).lower()] if head else None
        inline = None if head else "human" if HUMAN.match(line) else "assistant" if ASSISTANT.match(line) else None
        self.speaker = name or inline or self.speaker
        low, before = line.lower(), self.inside
        if head:
            self.inside = False
        elif "<thinking>" in low and self.speaker:
            self.inside = True
        elif "</thinking>" in low:
            self.inside = False
        opens = self.inside and not before
        if head or inline or opens or self.closed:
            yield from self.shut()
            self.opened = opens
        self.closed = before and not self.inside and not head
        if not self.speaker:
            return
        self.owner = self.owner or self.speaker
        self.last = number
        if not head:
            self.first = number if self.first is None else self.first
            found = (HUMAN if self.speaker == "human" else ASSISTANT).match(line) if inline else None
            self.lines.append(found.group(1) if found else line)

    def shut(self) -> Iterator[tuple]:
        """The open segment, if it says anything."""
        content = "\n".join(self.lines).strip()
        if content:
            self.any, self.all = True, []
            kind = "thinking" if self.opened else "text"
            if self.thinking or kind == "text":
                yield self.key, self.first, self.last, self.owner, kind, content
        self.first, self.last, self.owner, self.opened, self.lines = None, None, None, False, []

    def terminate(self) -> Iterator[tuple]:
        yield from self.shut()
        if self.last_line is not None and not self.any:
            yield self.key, 0, self.last_line, "unknown", "text", "\n".join(self.all)


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the function is known from now on."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(NAME, udtf(Segments))
    return spark
