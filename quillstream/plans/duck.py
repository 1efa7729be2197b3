"""Pieces of DuckDB SQL for the oracles: the same measures as the column functions, written for that engine."""

from __future__ import annotations

from ..sources.tables import LEXICON, MARKERS, SHORT_MARKERS


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def woven(text: str, index: str) -> str:
    pick = lambda values: f"({array(values)})[(({index}) % {len(values)} + 1)::BIGINT]"
    return f"({text} || ' ' || {pick(MARKERS)} || ' ' || {pick(SHORT_MARKERS)})"


NOTES = f"notes AS (SELECT doc_id, lang, source, {woven('text', 'doc_id')} AS text FROM documents)"
TALKS = f"talks AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN 'user' ELSE role END AS role, {woven('text', 'conv_id * 31 + turn')} AS text FROM conversations)"
WORDS = "lexicon(word, valence, arousal) AS (VALUES " + ", ".join(f"({lit(w)}, {v}::DOUBLE, {a}::DOUBLE)" for w, v, a in LEXICON) + ")"


def hits(low: str, tokens: list[str]) -> str:
    return "(" + " + ".join(f"contains({low}, {lit(t)})::INT" for t in tokens) + ")"


def occurrences(low: str, tokens: list[str]) -> str:
    return "(" + " + ".join(f"((length({low}) - length(replace({low}, {lit(t)}, ''))) // {len(t)})" for t in tokens) + ")"


def matches(text: str, patterns: list[str], flags: str = "i") -> str:
    prefix = f"(?{flags})" if flags else ""
    return "(" + " + ".join(f"len(regexp_extract_all({text}, {lit(prefix + p)}))" for p in patterns) + ")"


def found(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, {lit((f'(?{flags})' if flags else '') + pattern)})"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def sentences(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?]+(?:\\s|$)'), lambda s: {stripped('s')}), lambda s: s <> '')"


def steps(count: str, *levels: tuple[float, float]) -> str:
    return "(CASE " + " ".join(f"WHEN ({count}) >= {least} THEN {score}" for least, score in levels) + " ELSE 0 END)"


def r3(value: str, digits: int = 3) -> str:
    """Three digits (or others), halves away from zero, once the noise of sums is off."""
    x = f"round(({value})::DOUBLE, 9)"
    return f"(sign({x}) * floor(abs({x}) * {10**digits} + 0.500000001) / {10**digits})"


def draw(key: str, seed: int | str) -> str:
    """A whole number under 2^48 drawn from a key (text) and a seed."""
    return f"('0x' || substr(md5({key} || '|' || {seed}), 1, 12))::BIGINT"


CHUNKS = f"""{TALKS},
t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Human' ELSE 'Assistant' END AS role, text FROM talks WHERE role IN ('user', 'assistant')),
marked AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role THEN 1 ELSE 0 END AS changed FROM t),
numbered AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked),
coalesced AS (SELECT conv_id, run::BIGINT AS run, min(turn) AS turn, any_value(role) AS role,
  list_reduce(list({stripped('text')} ORDER BY turn), lambda a, b: CASE WHEN a = b THEN a WHEN a = '' THEN b ELSE a || chr(10) || chr(10) || b END) AS text
  FROM numbered GROUP BY conv_id, run),
ahead AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY run) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY run) AS voice_b FROM coalesced),
pairs AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY run) - 1)::INT AS pair, text AS voice_a, voice_b FROM ahead WHERE role = 'Human' AND next_role = 'Assistant'),
listed AS (SELECT conv_id, list('=== Voice A ===' || chr(10) || voice_a || chr(10) || chr(10) || '=== Voice B ===' || chr(10) || voice_b ORDER BY pair) AS ps FROM pairs GROUP BY conv_id),
sizes(pair_count, stride) AS (VALUES (1, 1), (2, 1), (3, 2), (4, 2)),
placed AS (SELECT conv_id, pair_count, stride, ps, unnest(generate_series(0, len(ps) - pair_count, stride)) AS start FROM listed, sizes WHERE len(ps) >= pair_count),
chunks AS (SELECT conv_id, pair_count, (start // stride)::INT AS chunk_index, array_to_string(ps[start + 1 : start + pair_count], chr(10) || chr(10)) AS text,
  DATE '2024-01-01' + (conv_id * 7 % 90)::INT AS source_date,
  (CASE ((conv_id + start // stride) % 5)::INT WHEN 0 THEN ['meta-commentary'] WHEN 1 THEN ['resolution / closure'] WHEN 2 THEN ['affectively loaded / emotional', 'meta-commentary'] WHEN 3 THEN ['logistics'] ELSE [] END) AS tags
  FROM placed)"""
