"""DuckDB SQL of the training-data queries that SQL can express, written from their contracts."""

OP12 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s,
         unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS k
  FROM d WHERE len(w) >= 20),
gone AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS place FROM win) WHERE place > 1),
covered AS (
  SELECT DISTINCT doc_id, s + j AS word FROM gone, range(20) AS t(j)),
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
left_over AS (
  SELECT a.doc_id, a.place, a.word FROM words a
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = a.doc_id AND c.word = a.place)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t FROM left_over GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

# A cheapest path by rows: the best (cost, audit) of each state after each row; a row's ways are 0 to 2 inserted turns, then an edit.
OP13 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
crc_bits AS (
  SELECT i AS byte, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
         lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) AS t(i)),
crc_table AS (SELECT list(v ORDER BY byte) AS t FROM crc_bits),
hashed AS (
  SELECT k.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 20 AS kind
  FROM keyed k, crc_table),
after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM after),
flagged AS (
  SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM numbered),
step AS (
  SELECT conv_id, 0 AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
      SELECT p.conv_id, f.i, CASE e WHEN 'D' THEN p.at WHEN 'K' THEN CASE f.r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE p.turned END AS state,
             p.cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND f.open THEN 3 ELSE 0 END AS cost,
             p.audit || e AS audit,
             CASE e WHEN 'D' THEN p.lines WHEN 'K' THEN list_append(p.lines, f.role || ':' || f.text)
                    ELSE list_append(p.lines, CASE p.turned WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text) END AS lines
      FROM (
        SELECT conv_id, i, n, s.cost + 3 * n AS cost, s.audit || repeat('I', CAST(n AS INT)) AS audit,
               CASE WHEN n = 0 THEN state WHEN (n = 1) = (state = 2) THEN 3 ELSE 2 END AS at,
               CASE WHEN n = 0 THEN CASE WHEN state = 2 THEN 3 ELSE 2 END WHEN (n = 1) = (state = 2) THEN 2 ELSE 3 END AS turned,
               CASE n WHEN 0 THEN lines WHEN 1 THEN list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END)
                      ELSE list_concat(lines, CASE WHEN state = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) END AS lines
        FROM step s, range(3) AS t(n)) p
      JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
      CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS v(e)
      WHERE e = 'D' OR (NOT f.blank AND NOT f.again AND (
            e = 'R' OR (f.r = 's' AND p.at = 0) OR (f.r = 'u' AND p.turned = 2) OR (f.r = 'a' AND p.turned = 3))))) WHERE place = 1),
ends AS (
  SELECT conv_id, state, i, cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost,
         audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         CASE state WHEN 1 THEN list_concat(lines, ['user:', 'assistant:']) WHEN 2 THEN list_append(lines, 'assistant:') ELSE lines END AS lines
  FROM step QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
best AS (
  SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
pairs AS (
  SELECT conv_id, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM flagged),
illegal AS (
  SELECT conv_id, count(*) AS n FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
sums AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND open) AS truncated
  FROM flagged GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(g.n, 0) AS BIGINT) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit,
       sha256(array_to_string(b.lines, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN illegal g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""

ORACLE = {"op12_count_min_substring": OP12, "op13_hirschberg_repair": OP13}
