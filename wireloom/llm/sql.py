"""DuckDB twins of the operator queries, where SQL can express them."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op10_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS symbols, length(coalesce(text, '')) AS chars
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT)
              + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN text IS NULL THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, 1 - 5 * (CAST(symbols AS DOUBLE) / greatest(chars, 1))) END AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM k GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS i FROM s),
l AS (
  SELECT a.i, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce((SELECT sum(b.cap) FROM r b WHERE b.i < a.i), 0))
              / (SELECT sum(b.weight) FROM r b WHERE b.i >= a.i) AS level, a.full_at FROM r a),
f AS (SELECT arg_min(level, i) AS final FROM l WHERE full_at > level),
t AS (SELECT source, source_size, coalesce(least(cap, weight * final), cap) AS target FROM r, f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id) AS DOUBLE) - k.size / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       size * (epochs + CASE WHEN middle <= rest THEN 1 ELSE 0 END) AS taken
FROM c
"""

ORACLE_SQL["op6_list_intervals"] = r"""
WITH p AS (
  SELECT page_id, url, CAST(1704067200 + page_id * 7919 % 31536000 AS BIGINT) AS fetched_at,
         nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.$', '')), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS part
  FROM pages),
n AS (
  SELECT host AS entry, 'block' AS action FROM p UNION SELECT regexp_replace(host, '^[^.]*\.', ''), 'block' FROM p
  UNION SELECT host || '/' || part, 'allow' FROM p),
d AS (
  SELECT entry, action, CAST('0x' || substr(md5(entry), 1, 6) AS BIGINT) AS draw FROM n WHERE entry IS NOT NULL),
l AS (
  SELECT entry, action, draw, 1704067200 + draw % 300 * 86400 AS day FROM d WHERE draw % 5 < 3),
c AS (
  SELECT entry, action, day AS listed FROM l
  UNION ALL SELECT entry, 'remove', day + 40 * 86400 FROM l WHERE draw % 7 >= 3
  UNION ALL SELECT entry, action, day + 90 * 86400 FROM l WHERE draw % 7 >= 3),
o AS (
  SELECT entry, listed, max_by(action, CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) AS action FROM c GROUP BY entry, listed),
i AS (SELECT entry, action, listed AS since, lead(listed) OVER (PARTITION BY entry ORDER BY listed) AS until FROM o),
m AS (
  SELECT p.page_id, p.url, i.entry, i.action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.entry) DESC, i.entry DESC) AS r
  FROM p JOIN i ON i.action <> 'remove' AND p.fetched_at >= i.since AND (i.until IS NULL OR p.fetched_at < i.until)
       AND (i.entry = p.host OR ends_with(p.host, '.' || i.entry) OR i.entry = p.host || '/' || p.part
            OR ends_with(p.host || '/' || p.part, '.' || i.entry)))
SELECT p.page_id, p.url, p.fetched_at, p.host, coalesce(m.action = 'block', false) AS blocked, m.entry, m.action
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""

ORACLE_SQL["op7_pivot_search"] = r"""
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM d),
b AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN e THEN 'E' ELSE '' END AS failed
  FROM w),
l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM b LEFT JOIN l USING (doc_id) GROUP BY part, failed),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x
    AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS filter, filter_order[:i] AS upto, filter_order[:i - 1] AS before
  FROM o, range(1, 6) r(i)),
t AS (
  SELECT part, filter_order, step, filter, n, good, toxic, contains(failed, filter) AS fails, failed = filter AS only_this,
         regexp_matches(failed, '[' || upto || ']') AS gone,
         CASE WHEN before = '' THEN false ELSE regexp_matches(failed, '[' || before || ']') END AS earlier
  FROM c, s),
g AS (
  SELECT part, filter_order, step, filter,
         CAST(coalesce(sum(n) FILTER (NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails AND earlier), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (only_this), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS toxic_lost
  FROM t GROUP BY part, filter_order, step, filter)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g
"""

ORACLE_SQL["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v.v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (k.n + 5) // (v.total + 5 * v.v) AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= 50
"""
