"""SQL of the operators on conversations and of centroid clustering."""

from __future__ import annotations

SQL_OP11 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length('<|im_start|>') + 1 + length('<|im_end|>') + 1 + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>'))
    + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: CRC-32 by its bits, then the search as a table of the best way to each state after each row.
SQL_OP12 = r"""
WITH RECURSIVE
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc_steps AS (SELECT key, 0 AS pos, 4294967295::BIGINT AS c FROM (SELECT DISTINCT key FROM hit)
  UNION ALL
  SELECT key, pos + 1, list_reduce([xor(c, ascii(key[pos + 1])), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
  FROM crc_steps WHERE pos < length(key)),
crc AS (SELECT key, xor(c, 4294967295) % 20 AS kind FROM crc_steps WHERE pos = length(key)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit JOIN crc USING (key) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS core
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(core, '[.!?]\z') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
moves(was, now, cost, audit, rows) AS (
  SELECT * FROM (VALUES ('', '', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
    ('', 'u', 5, 'I', ['user:']), ('s', 'u', 5, 'I', ['user:']), ('a', 'u', 5, 'I', ['user:']), ('u', 'a', 5, 'I', ['assistant:']),
    ('', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']))),
edits AS (
  SELECT j.conv_id, j.i, m.was, e.now, m.cost + e.cost + CASE WHEN fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END AS cost, m.audit || e.letter AS audit,
    list_concat(m.rows, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE e.now WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END) AS rows
  FROM judged j CROSS JOIN moves m JOIN (VALUES ('', '', 'D', 2), ('s', 's', 'D', 2), ('u', 'u', 'D', 2), ('a', 'a', 'D', 2),
    ('', 's', 'K', 0), ('', 'u', 'K', 0), ('s', 'u', 'K', 0), ('a', 'u', 'K', 0), ('u', 'a', 'K', 0),
    ('', 'u', 'R', 1), ('s', 'u', 'R', 1), ('a', 'u', 'R', 1), ('u', 'a', 'R', 1)) e(was, now, letter, cost) ON e.was = m.now
  WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR e.now = initial))),
best AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]} AS way FROM counted
  UNION ALL
  SELECT b.conv_id, b.i + 1, e.now, min({'cost': (b.way.cost + e.cost)::BIGINT, 'audit': b.way.audit || e.audit, 'rows': list_concat(b.way.rows, e.rows)})
  FROM best b JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.was = b.state GROUP BY b.conv_id, b.i + 1, e.now),
ended AS (
  SELECT c.conv_id, min({'cost': (b.way.cost + m.cost)::BIGINT, 'audit': b.way.audit || m.audit, 'rows': list_concat(b.way.rows, m.rows)}) AS way
  FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n JOIN moves m ON m.was = b.state WHERE m.now IN ('', 'a') GROUP BY c.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _rounds(n: int) -> str:
    """Assignment and means of round n; the sum's remainder is taken off first, as whole division rounds to zero."""
    assign = f"""
d{n} AS MATERIALIZED (SELECT rid, c, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN c{n} USING (p) GROUP BY rid, c),
a{n} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY rid),"""
    means = f"""
m{n} AS (SELECT c, p, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y FROM a{n} JOIN parts USING (rid) GROUP BY c, p),
c{n + 1} AS MATERIALIZED (SELECT c, p, coalesce(m.y, o.y) AS y FROM c{n} o LEFT JOIN m{n} m USING (c, p)),"""
    return assign + (means if n < 3 else "")


SQL_OP13 = (
    r"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM kept QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, p, x AS y FROM seeds JOIN parts USING (rid)),"""
    + "".join(map(_rounds, range(4)))
    + r"""
sums AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY c),
ends AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT k.vec_id, a.c::INT AS cluster, a.d AS distance, s.cluster_inertia, (SELECT sum(d)::BIGINT FROM a3) AS inertia, e.centroid_sha256
FROM kept k JOIN a3 a USING (rid) JOIN sums s ON s.c = a.c JOIN ends e ON e.c = a.c
"""
)
