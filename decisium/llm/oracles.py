"""DuckDB SQL of the operators that SQL can express: each states its rule anew,
without the operator's method, and compares everything with everything."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Least node that each node reaches over pair(a, b).
_COMPONENTS = """
reach AS (
  SELECT a AS node, b AS other FROM pair UNION SELECT b, a FROM pair
  UNION
  SELECT r.node, p.other FROM reach r JOIN (SELECT a AS node, b AS other FROM pair UNION ALL SELECT b, a FROM pair) p ON r.other = p.node),
comp AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""

#: Pairs that share a shingle among the rarest that similar sets can't all lack, then whole sets.
OP2_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words WHERE len(w) > 0),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
often AS (SELECT x, count(*) AS df FROM one GROUP BY x),
ranked AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS k FROM one JOIN often USING (x)),
heads AS (SELECT doc_id, n, x FROM ranked WHERE k <= n - (4 * n + 4) // 5 + 1),
maybe AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
shared AS (SELECT a, b, s.n AS n_a, t.n AS n_b, count(*) AS common FROM maybe JOIN one s ON s.doc_id = a JOIN one t ON t.doc_id = b AND t.x = s.x GROUP BY ALL),
pair AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (n_a + n_b - common)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(len(s), 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN comp ON comp.node = d.doc_id
"""

OP4_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k, len(w) AS n FROM words),
windows AS (SELECT doc_id, k, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS x FROM one),
seen AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY x) AS first FROM windows WHERE k + 13 <= n),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS g FROM seen WHERE first < doc_id),
kept AS (
  SELECT one.doc_id, count(g) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (g IS NULL) AS kept
  FROM one LEFT JOIN gone ON gone.doc_id = one.doc_id AND g = k GROUP BY one.doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: Each run's first holder, and the lines that runs of others cover.
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, k, sum((line <> '')::INT) OVER (PARTITION BY doc_id ORDER BY k) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)),
words AS (
  SELECT doc_id, n, line, coalesce(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: greatest(1,
    (2 * length(regexp_replace(w, '[^\x{3040}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{33FFF}]', '', 'g'))
     + length(regexp_replace(w, '[^\x{0E00}-\x{10BF}\x{1780}-\x{17FF}]', '', 'g'))) // 4))), 0) AS u
  FROM lines WHERE line <> ''),
sums AS (SELECT *, (sum(u) OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS c FROM words),
docs AS (SELECT doc_id, list(line ORDER BY n) AS l, [0] || list(c ORDER BY n) AS c FROM sums GROUP BY doc_id),
ends AS (SELECT doc_id, l, c, unnest(range(1, len(l) + 1)) AS i FROM docs),
runs AS (
  SELECT doc_id, i AS s, greatest(i, len(list_filter(c, lambda x: x < c[i] + 10))) AS e, l FROM ends WHERE c[-1] - c[i] >= 10
  UNION
  SELECT doc_id, least(i, len(list_filter(c, lambda x: x <= c[i + 1] - 10))) AS s, i AS e, l FROM ends WHERE c[i + 1] >= 10),
seen AS (SELECT doc_id, s, e, min(doc_id) OVER (PARTITION BY array_to_string(l[s:e], chr(10))) AS first FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS n FROM seen WHERE first < doc_id),
kept AS (
  SELECT l.doc_id, count(g.n) FILTER (l.line <> '') AS n_removed, count(*) FILTER (l.line <> '') AS n_lines,
         string_agg(l.line, chr(10) ORDER BY l.k) FILTER (l.line = '' OR g.n IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n AND l.line <> '' GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN n_removed > 0 AND n_removed = n_lines THEN '' ELSE coalesce(kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = rf"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, p) AS w FROM documents, pattern),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, p) AS w FROM benchmark, pattern),
sizes AS (SELECT item, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sizes)),
starts AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM sizes)),
hits AS (SELECT s.doc_id, s.i, s.m, item FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM starts) s JOIN windows USING (m, x)),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: Bytes as hex digits; each piece of 100 bytes with the next one holds the strings that start in it.
OP9_SQL = """
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(x, '.{1,200}') AS p, len(x) // 2 AS n FROM docs WHERE len(x) >= 200),
pieces AS (SELECT doc_id, n, q, p[q + 1] || coalesce(p[q + 2], '') AS two FROM (SELECT *, unnest(range(len(p))) AS q FROM cut)),
starts AS (SELECT doc_id, 100 * q + r AS pos, md5(substr(two, 2 * r + 1, 200)) AS x FROM (SELECT *, unnest(range(100)) AS r FROM pieces) WHERE 100 * q + r + 100 <= n),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) AS k FROM starts) WHERE k > 1),
edges AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 100, true)::INT AS new FROM later),
named AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM edges),
spans AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 100 AS b FROM named GROUP BY doc_id, k),
lists AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, [0] || list(b ORDER BY a) AS froms, list(a ORDER BY a) AS tos FROM spans GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(1, n_spans + 2),
         lambda i: CASE WHEN i <= n_spans THEN substr(x, 2 * froms[i] + 1, 2 * (tos[i] - froms[i])) ELSE substr(x, 2 * froms[i] + 1) END), '') END)) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
many AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM pair UNION ALL SELECT b FROM pair) GROUP BY x),
{_COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN many ON x = vec_id LEFT JOIN comp ON node = vec_id
"""

#: A node is the whole sequence of its turns; each conversation's nodes lie above one another.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
  FROM sizes),
rebuilt AS (
  SELECT v.c, t.k AS d, role, text FROM convs v JOIN turns t ON t.c = base AND t.k <= h
  UNION ALL
  SELECT v.c, least(h, coalesce(n, 0)) + t.k - h AS d, role, text FROM convs v LEFT JOIN sizes s ON s.c = base JOIN turns t ON t.c = v.c AND t.k > h),
prefixes AS (SELECT c, d, md5(to_json(list([role, text]) OVER (PARTITION BY c ORDER BY d))::VARCHAR) AS key, octet_length(encode(text)) AS b FROM rebuilt),
members AS (SELECT c, d, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') AS up, b FROM prefixes UNION ALL SELECT c, 0, '', NULL, 0 FROM convs),
nodes AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * any_value(b) AS saved FROM members GROUP BY key, d),
children AS (SELECT up AS key, count(*) AS n FROM nodes GROUP BY up),
below AS (SELECT DISTINCT a.key, e.key AS other FROM members a JOIN members e ON a.c = e.c AND a.d <= e.d),
sums AS (SELECT b.key, sum(saved)::BIGINT AS saved, count(*) FILTER (n IS NULL) AS leaves FROM below b JOIN nodes o ON o.key = other LEFT JOIN children c ON c.key = other GROUP BY b.key),
ends AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max_by(key, d) AS key FROM members GROUP BY c) GROUP BY key)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, coalesce(n, 0) AS n_children, leaves AS n_leaves, s.saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes o LEFT JOIN nodes p ON p.key = o.up LEFT JOIN children c ON c.key = o.key JOIN sums s ON s.key = o.key LEFT JOIN ends e ON e.key = o.key
"""

#: The pages of these tables hold their main text in one article of headings, paragraphs and breaks, and few character references.
OP12_SQL = r"""
WITH bodies AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '<br>|</?p>|</?h[1-6]>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM bodies),
decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM plain),
texts AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
