"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tidemark.llm.queries import CONTROL

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>')"

_OP3 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '{CONTROL}'), (-7::BIGINT, 1::BIGINT, 'assistant', '{CONTROL}'))
), told AS (
  SELECT *, length('### ' || replace({_ESCAPED.format('role')}, ':', '\c') || ': ' || {_ESCAPED.format('text')} || ' </turn>' || chr(10)) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = f"list_filter(string_split(translate(coalesce(text, ''), {_WS}, '     '), ' '), lambda w: w <> '')"

_PLAIN_LINE = "trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '))"

# runs grow by a line in each step; r is the first place with the same l lines
_OP6 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), every AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM split
), seq AS (
  SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) AS p, sum(length(line)) OVER (ORDER BY doc_id, pos) AS upto FROM every WHERE {_PLAIN_LINE} <> ''
), one AS (
  SELECT doc_id, p, min(p) OVER (PARTITION BY line) AS r FROM seq QUALIFY count(*) OVER (PARTITION BY line) > 1
), grown AS (
  SELECT 1 AS l, doc_id, p, r FROM one
  UNION ALL
  SELECT l + 1, doc_id, p, r FROM (
    SELECT g.l, g.doc_id, g.p, min(g.p) OVER (PARTITION BY g.r, o.r) AS r, count(*) OVER (PARTITION BY g.r, o.r) AS n
    FROM grown g JOIN one o ON o.p = g.p + g.l AND o.doc_id = g.doc_id) WHERE n > 1
), longest AS (
  SELECT p, max(l) AS l FROM grown WHERE r < p GROUP BY p
), heavy AS (
  SELECT a.p, a.p + g.l - 1 AS e FROM longest g JOIN seq a ON a.p = g.p JOIN seq z ON z.p = g.p + g.l - 1 WHERE z.upto - a.upto + length(a.line) >= 50
), marked AS (
  SELECT s.doc_id, s.pos, coalesce(max(e) OVER (PARTITION BY s.doc_id ORDER BY s.p) >= s.p, false) AS gone FROM seq s LEFT JOIN heavy h ON h.p = s.p
), kept AS (
  SELECT e.doc_id, e.pos, e.line, coalesce(m.gone, false) AS gone FROM every e LEFT JOIN marked m ON e.doc_id = m.doc_id AND e.pos = m.pos
)
SELECT d.doc_id, count(k.pos) AS n_lines, count(*) FILTER (WHERE k.gone) AS n_removed,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE NOT k.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""

_OP7 = f"""
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(translate(x, {_WS}, '     ')) <> '') AS ls FROM documents
), grams AS (
  SELECT doc_id, i, ws[i : i + 2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM told)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(text) - length(translate(text, '0123456789', '')) AS n_digits,
    len(list_filter(ls, lambda x: suffix(x, '...') OR suffix(x, chr(8230)))) AS n_ellipsis
  FROM told t LEFT JOIN repeats r ON t.doc_id = r.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR 100 * n_digits > 30 * word_chars OR 100 * n_ellipsis > 30 * n_lines) AS kept
FROM b
"""

_OP8 = f"""
WITH told AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM told)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(generate_series(0, 19)) AS o)),
every AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w FROM told),
kept AS (SELECT e.*, g.i IS NOT NULL AS gone FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i)
SELECT d.doc_id, count(k.i) AS n_words, count(*) FILTER (WHERE k.gone) AS n_removed,
  sha256(coalesce(string_agg(k.w, ' ' ORDER BY k.i) FILTER (WHERE NOT k.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""

ORACLES: dict[str, str] = {
    "op3_chat_formatting": _OP3,
    "op6_line_dedup": _OP6,
    "op7_quality_rules": _OP7,
    "op8_substring_dedup": _OP8,
}
