"""DuckDB SQL for the queries that SQL can express."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT doc_id, line, pos, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH pieces AS (
  SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS p, len(s) AS total FROM (
    SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''),
      '([.!?])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), '(\n)([^\n])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s
    FROM documents)),
keyed AS (SELECT doc_id, p, regexp_replace(translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g') AS k FROM pieces),
units AS (SELECT doc_id, p, k, len(string_split(k, ' ')) AS w,
                 row_number() OVER (PARTITION BY doc_id ORDER BY p) AS u FROM keyed WHERE k <> ''),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY u) AS upto FROM units),
ends AS (SELECT a.doc_id, a.u, min(b.u) AS e FROM summed a JOIN summed b
         ON a.doc_id = b.doc_id AND b.u BETWEEN a.u + 1 AND a.u + 9 AND b.upto - a.upto + a.w >= 10 GROUP BY ALL
         UNION ALL SELECT doc_id, u, u FROM units WHERE w >= 25),
runs AS (SELECT e.doc_id, e.u, e.e, min(x.p) AS first, max(x.p) AS last, string_agg(x.k, chr(2) ORDER BY x.u) AS k
         FROM ends e JOIN units x ON x.doc_id = e.doc_id AND x.u BETWEEN e.u AND e.e GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS p FROM later)
SELECT p.doc_id, CASE WHEN max(p.total) = 1 AND max(p.s) = '' THEN 0 ELSE max(p.total) END AS n_sentences,
       count(g.p) AS n_removed,
       sha256(coalesce(string_agg(p.s, '' ORDER BY p.p) FILTER (WHERE g.p IS NULL), '')) AS kept_sha256
FROM pieces p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id
"""

CONVERSATION_TRIE = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
             lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)),
heads AS (SELECT ids.c, t.i AS pos, t.role, t.text FROM ids JOIN turns t ON t.c = ids.base AND t.i <= ids.h),
taken AS (SELECT ids.c, ids.h, count(heads.pos) AS n FROM ids LEFT JOIN heads ON heads.c = ids.c GROUP BY ids.c, ids.h),
built AS (
  SELECT c, pos, role, text FROM heads UNION ALL
  SELECT t.c, t.i - k.h + k.n, t.role, t.text FROM turns t JOIN taken k ON k.c = t.c WHERE t.i > k.h),
paths AS (
  SELECT c, pos, length(text) AS n_chars, string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
           OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM built
  UNION ALL SELECT c, 0, 0, '' FROM ids),
sized AS (SELECT *, max(pos) OVER (PARTITION BY c) AS n, lag(path) OVER (PARTITION BY c ORDER BY pos) AS above FROM paths),
nodes AS (
  SELECT path, pos AS depth, min(c) AS conv_id, min(above) AS above, count(*) AS n_convs, max(n_chars) AS n_chars, max(n) > pos AS inner_node,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = pos), '') AS ends FROM sized GROUP BY path, pos),
sums AS (
  SELECT p.path, count(*) FILTER (WHERE NOT m.inner_node) AS n_leaves, sum((m.n_convs - 1) * m.n_chars) AS saved
  FROM nodes m JOIN sized p ON p.c = m.conv_id AND p.pos <= m.depth GROUP BY p.path),
children AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums s ON s.path = x.path LEFT JOIN children k ON k.above = x.path
LEFT JOIN nodes u ON x.depth > 0 AND u.path = x.above
"""
