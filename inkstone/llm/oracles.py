"""DuckDB SQL for the operators that SQL can express."""

LOWER_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({LOWER_ASCII.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY ALL),
links AS (
  SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (SELECT rid, rid AS r FROM w UNION SELECT reach.rid, y FROM reach JOIN links ON x = r)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(v.doc_id) AS component_id, coalesce(any_value(l.n), 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (rid) LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = w.rid
JOIN reach USING (rid) JOIN w v ON v.rid = reach.r
GROUP BY w.rid, w.doc_id"""

CONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({LOWER_ASCII.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_ASCII.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS w, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT w FROM win),
spots AS (
  SELECT rid, i, w, array_to_string(ws[i:i + w - 1], ' ') AS g
  FROM (SELECT rid, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, lens WHERE len(ws) >= w)),
found AS (SELECT rid, i, spots.w, item_id FROM spots JOIN win ON spots.g = win.g AND spots.w = win.w),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + w)) AS p FROM (SELECT DISTINCT rid, i, w FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, y FROM reach JOIN links ON x = r)
SELECT v.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r) AS component_id, v.vec_id = min(r) AS kept
FROM v JOIN reach USING (vec_id) LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = v.vec_id
GROUP BY v.vec_id"""
