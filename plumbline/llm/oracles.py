"""DuckDB SQL of the operators that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
placed AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM sized),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS words FROM placed),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT row, p, s.size, item_id FROM (SELECT row, p, size, array_to_string(w[p:p + size - 1], ' ') AS words FROM spots) AS s JOIN windows ON s.size = windows.size AND s.words = windows.words),
covered AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + size)) AS q FROM hits) AS c GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) AS i GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

#: For documents whose ids tell them apart.
JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' '))) END AS s FROM d),
inc AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM inc a JOIN inc b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, n_in_component FROM sets JOIN (SELECT doc_id, min(other) AS component_id, count(*) AS n_in_component FROM reach GROUP BY doc_id) AS r USING (doc_id)
"""

_QUOTE = r"^([ \t>]*>)[ \t]?"
_ATTRIBUTION = r"(?i)^\s*(on .{4,200} wrote|am .{4,200} schrieb.{0,100}|le .{4,200} a écrit|el .{4,200} escribió)\s*:\s*$"
_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

_ORDER = "CASE WHEN {0} < 0 THEN '-' || lpad(CAST(CAST({0} AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') ELSE lpad(CAST({0} AS VARCHAR), 20, '0') END"

#: For messages that their four columns tell apart.
QUOTE_LINKS = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row, conv_id, turn, role, text, coalesce(regexp_matches(text, '(?m)^[ \t]*>'), FALSE) AS quoted FROM conversations),
raw AS (SELECT row, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT row, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM m WHERE quoted) AS s),
lines AS (SELECT row, i, length(regexp_replace(regexp_extract(line, '{_QUOTE}', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '{_QUOTE}', '') AS line FROM raw),
own AS (SELECT row, i, line FROM (SELECT *, coalesce(lead(level) OVER (PARTITION BY row ORDER BY i), 0) AS next FROM lines) AS n WHERE level = 0 AND NOT (regexp_matches(line, '{_ATTRIBUTION}') AND next > 0)),
cut AS (SELECT row, rtrim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s*\n', ''), ' ' || chr(9) || chr(10)) AS body FROM own GROUP BY row),
bodies AS (SELECT m.*, CASE WHEN quoted THEN coalesce(body, '') ELSE coalesce(text, '') END AS body FROM m LEFT JOIN cut USING (row)),
runs AS (SELECT row, i, level, {_NORMAL.format("line")} AS q, i - row_number() OVER (PARTITION BY row, level ORDER BY i) AS run FROM lines JOIN m USING (row) WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL),
quotes AS (SELECT * FROM runs WHERE q <> ''),
passages AS (SELECT row, level, run, string_agg(q, ' ' ORDER BY i) AS q, sum(length(q)) AS chars, count(*) AS n FROM quotes GROUP BY row, level, run),
known AS (SELECT conv_id, turn, body FROM bodies WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
wholes AS (SELECT conv_id, turn, {_NORMAL.format("part")} AS q FROM (SELECT conv_id, turn, body AS part FROM known UNION ALL SELECT conv_id, turn, unnest(string_split_regex(body, '\n[ \t]*\n')) FROM known) AS w),
own_lines AS (SELECT conv_id, turn, {_NORMAL.format("line")} AS q FROM (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS line FROM known) AS l),
first_wholes AS (SELECT conv_id, q, min(turn) AS o FROM wholes GROUP BY conv_id, q),
first_lines AS (SELECT conv_id, q, min(turn) AS o FROM own_lines GROUP BY conv_id, q),
linked AS (SELECT p.*, m.conv_id, m.turn, CASE WHEN o < m.turn THEN o END AS parent FROM passages p JOIN m USING (row) LEFT JOIN first_wholes f ON m.conv_id = f.conv_id AND p.q = f.q),
met AS (SELECT row, conv_id, turn, level, parent, chars, n FROM linked WHERE parent IS NOT NULL UNION ALL
  SELECT l.row, l.conv_id, l.turn, l.level, CASE WHEN o < l.turn THEN o END, length(x.q), 1 FROM linked l JOIN quotes x ON l.row = x.row AND l.level = x.level AND l.run = x.run LEFT JOIN first_lines f ON l.conv_id = f.conv_id AND x.q = f.q WHERE l.parent IS NULL),
votes AS (SELECT row, conv_id, turn, parent, min(level) AS level, sum(chars) AS chars, sum(n) AS n FROM met GROUP BY row, conv_id, turn, parent),
found AS (SELECT row, conv_id, turn, arg_max(parent, {{'a': -level, 'b': chars, 'c': parent}}) FILTER (WHERE parent IS NOT NULL) AS parent_turn, sum(n) AS quoted_lines, coalesce(sum(n) FILTER (WHERE parent IS NOT NULL), 0) AS linked_lines FROM votes GROUP BY row, conv_id, turn),
up AS (SELECT conv_id, turn, min(parent_turn) AS parent FROM found WHERE parent_turn IS NOT NULL GROUP BY conv_id, turn),
chain(conv_id, turn, root, depth) AS (SELECT conv_id, turn, parent, 1 FROM up UNION ALL SELECT chain.conv_id, chain.turn, up.parent, depth + 1 FROM chain JOIN up ON up.conv_id = chain.conv_id AND up.turn = root),
threads AS (SELECT conv_id, turn, min(root) AS thread_turn, max(depth) AS depth FROM chain GROUP BY conv_id, turn),
placed AS (SELECT b.*, parent_turn, quoted_lines, linked_lines, CASE WHEN parent_turn IS NULL THEN b.turn ELSE thread_turn END AS thread_turn, CASE WHEN parent_turn IS NULL THEN 0 ELSE depth END AS depth
  FROM bodies b LEFT JOIN found USING (row) LEFT JOIN threads ON threads.conv_id = b.conv_id AND threads.turn = b.turn)
SELECT conv_id, turn, role, body, CAST(coalesce(quoted_lines, 0) AS BIGINT) AS quoted_lines, CAST(coalesce(linked_lines, 0) AS BIGINT) AS linked_lines, parent_turn, thread_turn, CAST(depth AS INTEGER) AS depth,
  concat_ws('/', {_ORDER.format("thread_turn")}, {_ORDER.format("turn")}) AS reply_order, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || chr(10) || '<|end|>' AS chat
FROM placed
"""

SQL = {"op8_quote_links": QUOTE_LINKS, "op1_decontaminate": DECONTAMINATE, "op5_jaccard_join": JACCARD_JOIN}
