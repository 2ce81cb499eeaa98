"""SQL for the operators that DuckDB can express over whole tables (sf0.01)."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPACE}) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS c FROM x a JOIN x b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT u, v FROM p WHERE 100 * c >= 75 * (nu + nv - c)), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM s LEFT JOIN (SELECT u, min(v) AS m FROM r GROUP BY u) ON u = doc_id
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w FROM documents),
s AS (SELECT r, list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i+34], ' ')) AS ks FROM w WHERE len(w) >= 35),
k AS (SELECT r, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM s),
d AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
h AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k JOIN d USING (k)),
g AS (SELECT r, list(j) AS js, count(*) AS n FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (r)
"""

DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_ALNUM}) AS w FROM benchmark),
z AS (SELECT item_id, w, least(13, len(w)) AS z FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, z, unnest(list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(w[i:i+z-1], ' '))) AS k FROM z),
dw AS (SELECT r, z, list_transform(range(1, len(w) - z + 2), lambda i: array_to_string(w[i:i+z-1], ' ')) AS ks FROM w, (SELECT DISTINCT z FROM z) WHERE len(w) >= z),
dk AS (SELECT r, z, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM dw),
m AS (SELECT r, i, z, item_id FROM dk JOIN iw USING (z, k)),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + z)) AS j FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS c, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(c, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
