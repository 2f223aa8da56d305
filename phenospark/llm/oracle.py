"""DuckDB SQL for the rows of the queries that SQL can express, on plain strings instead of hashes."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS grams
  FROM w
),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) AS nx, any_value(y.n) AS ny
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (nx + ny - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

OP3 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), h AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM h),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE c > 1) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
),
c AS (SELECT * EXCLUDE (lines), len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
      OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS soft,
    100 * n_symbols > 100 * n_words OR 100 * n_dup_lines > 60 * n_lines AS gross,
    CASE WHEN regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) <> ''
      THEN lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) ELSE source END AS host
  FROM c
),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft) AS k FROM f GROUP BY host),
t AS (SELECT sum(k) / sum(n) AS mean, count(*) / sum(n) AS per, sum(n * (k / n) * (k / n)) / sum(n) AS pp FROM hosts),
b AS (SELECT mean, pp - mean * mean - mean * (1 - mean) * per AS between_hosts FROM t),
prior AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 2.0), 1000.0) ELSE 1000.0 END AS weight
  FROM b
),
v AS (SELECT host, (k + mean * weight) / (n + weight) > 0.5 AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT gross AND NOT (host_failed AND soft) AS kept, host_failed
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

OP4 = rf"""
WITH sized AS (SELECT doc_id, source, text, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio FROM w),
-- with the sources up to this one (in order of ratio) at their limit, the level of the others
l AS (
  SELECT ratio, source,
    (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(2.0 * source_size) OVER before, 0))
      / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
level AS (SELECT list(level ORDER BY ratio, source NULLS LAST)[1] AS level FROM l WHERE level < ratio),
plan AS (
  SELECT source, source_size, n_docs, least(2.0 * source_size, weight * level)::DOUBLE AS target,
    CASE WHEN source_size > 0 THEN least(2.0 * source_size, weight * level) / source_size ELSE 0 END::DOUBLE AS rate
  FROM r, level
),
j AS (
  SELECT doc_id, size, text, p.*, md5('1|' || coalesce(doc_id::VARCHAR, 'null')) AS md
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
),
k AS (SELECT *, ('0x' || md[9:16])::BIGINT % ceil(n_docs / 4096)::BIGINT AS chunk FROM j),
e AS (
  SELECT *, row_number() OVER (PARTITION BY source, chunk ORDER BY length(bin(size)), md, doc_id, coalesce(md5(text), ''))::DOUBLE AS rank,
    rate - floor(rate) AS fraction,
    ('0x' || md5('1|' || coalesce('s' || source, 'null') || '|' || chunk::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE AS phase
  FROM k
),
c AS (
  SELECT *, (floor(rate) + floor(rank * fraction + phase) - floor((rank - 1) * fraction + phase))::BIGINT AS copies FROM e
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

OP8 = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
n AS (
  SELECT *, row_number() OVER o AS pos, len({WORDS}) + 4 AS tokens, bool_and(role = 'system') OVER o AS lead,
    regexp_replace(text, '<(\\*)(/?s>)', '<\1\\\2', 'g') AS body
  FROM raw WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
),
s AS (
  SELECT *, length('<s>' || role || chr(10) || body || '</s>' || chr(10)) AS chars,
    coalesce(sum(CASE WHEN lead THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM n
),
l AS (SELECT *, greatest(2048 - coalesce(sum(tokens) FILTER (lead) OVER (PARTITION BY conv_id), 0), 0) AS room FROM s),
h AS (SELECT *, least(256, room // 4) AS back, greatest(room - least(256, room // 4), 1) AS stride FROM l),
c AS (
  SELECT *, CASE WHEN NOT lead THEN 2 * (start // stride) + CASE WHEN start // stride <> (start + tokens - 1) // stride THEN 1 ELSE 0 END END AS cell FROM h
),
w AS (
  SELECT conv_id, cell, min(start) AS begins, least(any_value(back), greatest(any_value(room) - sum(tokens), 0)) AS reach
  FROM c WHERE cell IS NOT NULL GROUP BY ALL
),
k AS (SELECT conv_id, count(*) AS n_windows FROM w GROUP BY conv_id),
history AS (
  SELECT c.conv_id, sum(chars) AS chars FROM c JOIN w
    ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND NOT c.lead AND c.start < w.begins AND w.begins - c.start <= w.reach
  GROUP BY c.conv_id
),
lead AS (SELECT conv_id, sum(chars) AS chars FROM c WHERE lead GROUP BY conv_id),
body AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    coalesce(sum(chars) FILTER (NOT lead), 0) AS chars
  FROM c GROUP BY conv_id
)
SELECT b.conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256,
  (b.chars + coalesce(h.chars, 0) + coalesce(l.chars, 0) * greatest(coalesce(n_windows, 1), 1))::BIGINT AS formatted_chars,
  coalesce(n_windows, 1)::BIGINT AS n_windows
FROM body b LEFT JOIN history h ON b.conv_id IS NOT DISTINCT FROM h.conv_id
LEFT JOIN lead l ON b.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN k ON b.conv_id IS NOT DISTINCT FROM k.conv_id
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
one AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

#: Costs are nine digits before the audit, so the least string is the cheapest, then the least audit.
#: Rows are never inserted: leaving out an inserted row and the other half of its pair costs less.
OP12 = r"""
WITH RECURSIVE poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
),
hashed AS (
  SELECT named.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM named, poly
),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM placed
),
costed AS (
  SELECT *, fault IS NULL OR fault = 'truncated' AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged
),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS a0, NULL::VARCHAR AS a1, NULL::VARCHAR AS a2, NULL::VARCHAR AS a3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT s.conv_id, r.i,
    lpad((left(a0, 9)::INT + 2)::VARCHAR, 9, '0') || substr(a0, 10) || 'D',
    least(lpad((left(a1, 9)::INT + 2)::VARCHAR, 9, '0') || substr(a1, 10) || 'D',
      CASE WHEN stays AND initial = 's' THEN lpad((left(a0, 9)::INT + extra)::VARCHAR, 9, '0') || substr(a0, 10) || 'K' END),
    least(lpad((left(a2, 9)::INT + 2)::VARCHAR, 9, '0') || substr(a2, 10) || 'D',
      CASE WHEN stays AND initial = 'u' THEN lpad((left(least(a0, a1, a3), 9)::INT + extra)::VARCHAR, 9, '0') || substr(least(a0, a1, a3), 10) || 'K' END,
      CASE WHEN stays THEN lpad((left(least(a0, a1, a3), 9)::INT + extra + 1)::VARCHAR, 9, '0') || substr(least(a0, a1, a3), 10) || 'R' END),
    least(lpad((left(a3, 9)::INT + 2)::VARCHAR, 9, '0') || substr(a3, 10) || 'D',
      CASE WHEN stays AND initial = 'a' THEN lpad((left(a2, 9)::INT + extra)::VARCHAR, 9, '0') || substr(a2, 10) || 'K' END,
      CASE WHEN stays THEN lpad((left(a2, 9)::INT + extra + 1)::VARCHAR, 9, '0') || substr(a2, 10) || 'R' END)
  FROM steps s JOIN costed r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1
),
ends AS (
  SELECT conv_id, arg_max(least(a0, a3), i) AS best FROM steps GROUP BY conv_id
),
kept AS (
  SELECT c.conv_id, c.i, c.role, c.text, substr(best, 9 + c.i::INT, 1) AS edit,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY c.i) AS j,
    first_value(substr(best, 9 + c.i::INT, 1) = 'K' AND initial = 's') OVER (PARTITION BY c.conv_id ORDER BY c.i) AS headed
  FROM costed c JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE substr(best, 9 + c.i::INT, 1) <> 'D'
),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole
  FROM kept GROUP BY conv_id
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""


ORACLE_SQL = {
    "op1_ngram_jaccard": OP1, "op3_quality_rules": OP3, "op4_mix_sources": OP4, "op7_substring_dedup": OP7, "op8_chat_windows": OP8,
    "op12_conversation_repair": OP12,
}
