"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from . import quality, sharding
from .quality import FUNCTION_WORDS, ITERATIONS, PRIOR, RULES, START_BAD, START_GOOD, START_SHARE, WINDOW


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql() -> str:
    """Counts by list functions, votes, EM with one CTE an iteration, posterior."""
    names = [f"v{j}" for j in range(len(RULES))]
    words = "list_filter(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    stop = "[" + ", ".join(_quoted(w) for w in FUNCTION_WORDS) + "]"
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    ctes = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)",
        f"w AS (SELECT *, {words} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d)",
        f"g AS (SELECT r, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i : i + {WINDOW - 1}], ' '))) AS s, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})",
        "rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g)",
        f"cov AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep WHERE n > 1) GROUP BY r)",
        f"c AS (SELECT doc_id, len(ws) AS n_words, length(t) - {count('[\\x20\\x09-\\x0D]')} AS word_chars, {count('[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, {count('[A-Z]')} AS n_upper, {count('!')} AS n_bangs, {count('[0-9]')} AS n_digits, len(list_filter(ws, lambda x: list_contains({stop}, x))) AS n_function, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r))",
        "votes AS (SELECT *, " + ", ".join(f"{quality.vote(rule)} AS v{j}" for j, rule in enumerate(RULES)) + " FROM c)",
        f"pat AS (SELECT {', '.join(names)}, count(*) AS c FROM votes GROUP BY ALL)",
        "p0 AS (SELECT " + f"{START_SHARE}::DOUBLE AS share, " + ", ".join(f"{START_GOOD}::DOUBLE AS a{j}, {START_BAD}::DOUBLE AS b{j}" for j in range(len(RULES))) + ")",
    ]
    terms = " + ".join(f"CASE v{j} WHEN 1 THEN greatest(0, ln(a{j} / (1 - b{j}))) WHEN -1 THEN least(0, ln((1 - a{j}) / b{j})) ELSE 0 END" for j in range(len(RULES)))
    posterior = f"1 / (1 + exp(-(ln(share / (1 - share)) + {terms})))"
    bound = lambda x: f"least({quality.HIGH}, greatest({quality.LOW}, {x}))"
    for k in range(ITERATIONS):
        ctes.append(f"e{k} AS (SELECT pat.*, c * ({posterior}) AS g FROM pat, p{k})")
        each = []
        for j in range(len(RULES)):
            good, bad = [f"coalesce(sum(g) FILTER (v{j} = {s}), 0)" for s in (1, -1)], [f"coalesce(sum(c - g) FILTER (v{j} = {s}), 0)" for s in (1, -1)]
            each.append(f"{bound(f'({good[0]} + {PRIOR} * sum(c) * {START_GOOD}) / ({good[0]} + {good[1]} + {PRIOR} * sum(c))')} AS a{j}")
            each.append(f"{bound(f'({bad[1]} + {PRIOR} * sum(c) * {START_BAD}) / ({bad[0]} + {bad[1]} + {PRIOR} * sum(c))')} AS b{j}")
        ctes.append(f"p{k + 1} AS (SELECT {bound('sum(g) / sum(c)')} AS share, {', '.join(each)} FROM e{k})")
    base = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    return f"WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND ({posterior}) >= 0.5 AS kept, round({posterior}, 6) AS quality FROM votes, p{ITERATIONS}"


def sharding_sql(shards: int = 8, key: int = 20240229) -> str:
    """Row numbers, the same network over md5 digests, and a walk by recursion."""

    def rounds(value: str) -> tuple[str, str]:
        a, b = f"(({value}) // rgt)", f"(({value}) % rgt)"
        for r in range(sharding.ROUNDS):
            mix = lambda v, m, r=r: f"(('0x' || substr(md5('{key}:{r}:' || {v}), 1, 12))::BIGINT % {m})"
            if r % 2 == 0:
                a = f"(({a} + {mix(b, 'lft')}) % lft)"
            else:
                b = f"(({b} + {mix(a, 'rgt')}) % rgt)"
        return a, b

    a, b = rounds("x")
    step = f"({a} * rgt + {b})"
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    bytes_ = "b AS (SELECT r, unnest(range(1, octet_length(encode(t)) + 1)) AS i, unnest(string_split(trim(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g')), ' ')) AS h FROM d WHERE t <> '')"
    values = ", ".join(f"({i}, {v}::UBIGINT)" for i, v in enumerate(table))
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
tab(k, v) AS (VALUES {values}), lookup AS (SELECT list(v ORDER BY k) AS l FROM tab),
{bytes_}, bl AS (SELECT r, list(('0x' || h)::UBIGINT ORDER BY i) AS bs FROM b GROUP BY r),
c AS (SELECT r, xor(list_reduce(bs, lambda c, v: xor(l[((xor(c, v) & 255) + 1)::BIGINT], c >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS crc FROM bl, lookup),
s AS (SELECT doc_id, (octet_length(encode(t)) + 1)::BIGINT AS size, coalesce(crc, 0) AS text_crc32 FROM d LEFT JOIN c USING (r)),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS num, count(*) OVER () AS total FROM s),
m AS MATERIALIZED (SELECT *, (floor(sqrt(total - 1)) + 1)::BIGINT AS rgt, greatest(1, ceil(total / (floor(sqrt(total - 1)) + 1)))::BIGINT AS lft FROM n),
walk AS (SELECT num, total, rgt, lft, {step.replace('(x)', '(num)')} AS x FROM m UNION ALL SELECT num, total, rgt, lft, {step} FROM walk WHERE x >= total),
p AS (SELECT num, x FROM walk WHERE x < total)
SELECT doc_id, size, text_crc32, '{sharding.LAW}' AS law, (x % {shards})::INT AS shard, x // {shards} AS slot, NULL::INT AS grown_shard FROM m JOIN p USING (num)"""


def url_sql(url_list: list[tuple[str, str, str, str]], step: int, year: int) -> str:
    """Intervals by lag and lead, keys by list functions, an as-of join on key and time."""
    events = ", ".join(f"({_quoted(k)}, {_quoted(e)}, {_quoted(a)}, TIMESTAMP {_quoted(t)})" for k, e, a, t in url_list)
    return f"""WITH ev(kind, entry, action, ts) AS (VALUES {events}), st AS (SELECT kind, lower(entry) AS entry, ts, bool_and(action = 'add') AS is_on FROM ev GROUP BY ALL),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY kind, entry ORDER BY ts), false) AS was FROM st) WHERE is_on <> was),
iv AS (SELECT kind, entry, ts AS valid_from, valid_to FROM (SELECT *, lead(ts) OVER (PARTITION BY kind, entry ORDER BY ts) AS valid_to FROM ch) WHERE is_on),
cp AS (SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * {step} % {year}) AS fetched_at,
  regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\\.+$', '') AS host, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k1 AS (SELECT *, string_split(host, '.') AS lb, list_filter(string_split(path, '/'), lambda x: x <> '') AS sp FROM cp WHERE host <> ''),
ks AS (SELECT r, 'host' AS kind, host AS entry FROM k1 UNION SELECT r, 'domain', array_to_string(lb[i:], '.') FROM k1, LATERAL (SELECT unnest(range(1, len(lb) + 1)) AS i) UNION SELECT r, 'prefix', host || '/' || array_to_string(sp[1:i], '/') FROM k1, LATERAL (SELECT unnest(range(1, len(sp) + 1)) AS i)),
hits AS (SELECT r, kind, entry, valid_from, valid_to FROM ks JOIN iv USING (kind, entry) JOIN cp USING (r) WHERE valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)),
best AS (SELECT *, count(*) OVER (PARTITION BY r) AS n, row_number() OVER (PARTITION BY r ORDER BY valid_from DESC, kind, entry) AS k FROM hits)
SELECT page_id, url, fetched_at, best.r IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, kind, entry, valid_from, valid_to FROM cp LEFT JOIN best ON best.r = cp.r AND k = 1"""


#: Exact classes and link counts: every pair with a common shingle, then the closure of the links.
JACCARD = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT t, min(doc_id) AS first, count(*) AS copies FROM d GROUP BY t),
n AS (SELECT *, row_number() OVER (ORDER BY first) AS id, list_filter(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM x),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM n),
z AS (SELECT id, count(*) AS size FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE 5 * k >= 4 * (p.size + q.size - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, other) AS (SELECT id, id FROM n UNION SELECT reach.id, b FROM reach JOIN both_ways ON other = a),
cls AS (SELECT reach.id, min(first) AS class_id FROM reach JOIN n ON n.id = other GROUP BY reach.id), deg AS (SELECT a AS id, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, copies FROM d JOIN n USING (t) JOIN cls USING (id) LEFT JOIN deg USING (id)"""


def codes_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Whole numbers by part, all distances, and a pair of CTEs a round."""
    dist = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT"
    ctes = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS (SELECT unnest(range(0, {parts})) AS part)",
        f"p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM k, q)",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"d{n} AS (SELECT p.r, part, b.entry, p.x, {dist} AS d FROM p JOIN b{n} AS b USING (part))")
        ctes.append(f"a{n} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS place FROM d{n}) WHERE place = 1)")
        if n < rounds:
            ctes.append(f"u{n} AS (SELECT part, entry, unnest(range(0, len(x))) AS i, unnest(x) AS c FROM a{n})")
            ctes.append(f"m{n} AS (SELECT part, entry, list(c ORDER BY i) AS x FROM (SELECT part, entry, i, floor(sum(c)::DOUBLE / count(*))::BIGINT AS c FROM u{n} GROUP BY ALL) GROUP BY ALL)")
            ctes.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (part, entry))")
    ctes.append(f"c AS (SELECT r, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)")
    ctes.append(f"s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), s"


def crc_ctes(source: str, text: str) -> str:
    """CTEs ending in crcs(r, crc): crc32 of the UTF-8 bytes of a column of a relation with row numbers r."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    values = ", ".join(f"({i}, {v}::UBIGINT)" for i, v in enumerate(table))
    return f"""tab(k, v) AS (VALUES {values}), lookup AS (SELECT list(v ORDER BY k) AS l FROM tab),
hexes AS (SELECT r, unnest(range(1, octet_length(encode({text})) + 1)) AS i, unnest(string_split(trim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g')), ' ')) AS h FROM {source} WHERE {text} <> ''),
lists AS (SELECT r, list(('0x' || h)::UBIGINT ORDER BY i) AS bs FROM hexes GROUP BY r),
crcs AS (SELECT r, xor(list_reduce(list_concat([4294967295::UBIGINT], bs), lambda c, v: xor(l[((xor(c, v) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT)::BIGINT AS crc FROM lists, lookup)"""


def repair_sql() -> str:
    """Damage, faults, then one step of recursion a row: the best label of each of the four states.

    A label is the cost in nine digits, the audit, a separator that sorts before letters and the repaired text, so the
    least string is the cheapest edit with the least audit.
    """

    def add(label: str, cost: str, edit: str, line: str = "''") -> str:
        cut = f"instr({label}, chr(31))"
        kept = f"substr({label}, {cut} + 1)"
        more = f"{kept} || CASE WHEN {line} = '' THEN '' WHEN {kept} = '' THEN {line} ELSE chr(10) || {line} END" if line != "''" else kept
        return f"lpad((substr({label}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({label}, 10, {cut} - 10) || '{edit}' || chr(31) || {more}"

    user, assistant = "('user:' || text)", "('assistant:' || text)"
    keep = lambda q, i: f"CASE WHEN free AND initial = '{i}' THEN {add(f'l{q}', 't', 'K', "(role || ':' || text)")} END"
    rename = lambda q, line: f"CASE WHEN free THEN {add(f'l{q}', '(3 + t)', 'R', line)} END"
    drop = lambda q: add(f"l{q}", "4", "D")
    moved = f"""SELECT conv, pos, {drop(0)} AS m0, least({drop(1)}, {keep(0, 's')}) AS m1,
least({drop(2)}, {', '.join(keep(q, 'u') for q in (0, 1, 3))}, {', '.join(rename(q, user) for q in (0, 1, 3))}) AS m2,
least({drop(3)}, {keep(2, 'a')}, {rename(2, assistant)}) AS m3
FROM (SELECT s.conv, n.pos, l0, l1, l2, l3, role, text, left(role, 1) AS initial, fault NOT IN ('blank', 'duplicate') AS free, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS t FROM s JOIN f AS n ON n.conv = s.conv AND n.pos = s.pos + 1)"""
    inserts = lambda q, line: add(f"m{q}", "3", "I", line)
    one = f"SELECT conv, pos, m0, m1, least(m2, {', '.join(inserts(q, "'user:'") for q in (0, 1, 3))}) AS m2, m3 FROM ({moved})"
    two = f"SELECT conv, pos, m0, m1, m2, least(m3, {inserts(2, "'assistant:'")}) AS m3 FROM ({one})"
    space = "\\x20\\x09-\\x0D"
    begin = ["'000000000' || chr(31)", "NULL::VARCHAR", "'000000003I' || chr(31) || 'user:'", "'000000006II' || chr(31) || 'user:' || chr(10) || 'assistant:'"]
    return f"""WITH RECURSIVE src AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations),
{crc_ctes("src", "mark")},
g AS (SELECT r, conv, turn, crc % 20 AS k, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role, CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM src JOIN crcs USING (r)),
h AS (SELECT conv, turn, role, text, unnest(range(0, CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair FROM h),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
s AS (SELECT DISTINCT conv, 0::BIGINT AS pos, {', '.join(f'{x} AS l{q}' for q, x in enumerate(begin))} FROM src UNION ALL SELECT conv, pos, m0, m1, m2, m3 FROM ({two})),
e AS (SELECT conv, max(pos) AS n FROM s GROUP BY conv), b AS (SELECT conv, least(l0, l3) AS l FROM s JOIN e USING (conv) WHERE pos = n),
c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT nullif(conv, ' ')::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
substr(l, 1, 9)::BIGINT AS cost, substr(l, 10, instr(l, chr(31)) - 10) AS audit, sha256(substr(l, instr(l, chr(31)) + 1)) AS repaired_sha256 FROM b LEFT JOIN c USING (conv)"""


def oracles() -> dict[str, str]:
    from .queries import FETCH_STEP, URL_LIST, YEAR_MINUTES

    return {
        "op2_quality_rules": quality_sql(),
        "op6_sharding": sharding_sql(),
        "op9_jaccard_join": JACCARD,
        "op12_conversation_repair": repair_sql(),
        "op13_vector_codes": codes_sql(),
        "op10_url_filters": url_sql(URL_LIST, FETCH_STEP, YEAR_MINUTES),
    }
