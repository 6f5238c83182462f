"""DuckDB SQL of sentence scores, trends and charts' data."""

from __future__ import annotations

from inkstone.functions import category_lists as C
from inkstone.functions import sentence_lists as L
from inkstone.functions.segment import WS
from inkstone.operators.charts import BINS, EDGES, FULL, LEAST_TOKENS, NODES, SEGMENTS, WINDOW
from inkstone.operators.sentence_scores import LEAST_TOKENS as LONG
from inkstone.plans.category_sql import _in
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import BASE, trimmed

_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
_WS_WORDS = "regexp_extract_all(lower(s), '[a-z0-9_''-]+')"

SENTENCES = rf"""
WITH {BASE},
m AS (SELECT doc_id, count(*) AS n_all FROM tok GROUP BY doc_id),
w AS (
  SELECT doc_id, no, s, len(ws) AS n, len(list_distinct(ws)) AS u, length(array_to_string(ws, '')) AS letters, len(regexp_extract_all(s, '[,;:]')) AS marks,
    len(regexp_extract_all(s, {_re2(L.PERSONAL)})) AS personal, {_in("lower(s)", L.DISCOURSE_MARKERS)} AS markers, {_in("lower(s)", L.SENTENCE_HEDGES)} AS hedges
  FROM (SELECT *, {_WS_WORDS} AS ws FROM sent)),
b AS (SELECT *, (lag(n) OVER o + lead(n) OVER o) / 2 AS beside FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
i AS (
  SELECT doc_id, no, s, n,
    CASE WHEN beside > 0 THEN 1 - least(1, abs(n - beside) / beside) WHEN beside = 0 AND n > 0 THEN 0 ELSE 0.5 END AS regularity,
    CASE WHEN n > 0 THEN u / n ELSE 0.5 END AS diversity, least(1, markers * 0.3) AS markers, least(1, personal * 0.2) AS personal, least(1, hedges * 0.25) AS hedging,
    CASE WHEN n_all >= {LONG} THEN greatest(10, least(100, u / greatest(n, 1) * 30 + letters / greatest(n, 1) * 2 + marks / greatest(n, 1) * 20 + 2.5)) / 100 ELSE 0.5 END AS surprise
  FROM b LEFT JOIN m USING (doc_id)),
p AS (SELECT *, round(((1 - regularity) * 0.15 + (1 - diversity) * 0.15 + markers * 0.25 + (1 - surprise) * 0.15 + (1 - personal) * 0.15 + hedging * 0.15)::DOUBLE, 9) AS p FROM i)
SELECT doc_id, no::BIGINT AS no, s AS sentence, n::BIGINT AS n_tokens, {_R("regularity")} AS regularity, {_R("diversity")} AS diversity, {_R("markers")} AS markers, {_R("surprise")} AS surprise,
  {_R("personal")} AS personal, {_R("hedging")} AS hedging, {_R("p")} AS ai_probability, CASE WHEN p < 0.35 THEN 'human' WHEN p > 0.6 THEN 'ai' ELSE 'mixed' END AS class
FROM p"""

_RULES = [
    ("cv < 0.3", "ai", "uniform sentence length", "cv"),
    ("cv > 0.6", "human", "variable sentence length", "cv"),
    ("paragraphs = 1 AND s > 5", "neutral", "single paragraph", "s"),
    ("repeated > 5", "ai", "repetitive vocabulary", "repeated"),
    ("phrases >= 2", "ai", "formulaic transitions", "phrases"),
    ("first / n > 0.02", "human", "personal voice", "first"),
    ("first / n < 0.005 AND s > 3", "ai", "impersonal tone", "first"),
    ("contractions > 3", "human", "natural contractions", "contractions"),
    ("contractions = 0 AND s > 5", "ai", "no contractions", "contractions"),
    ("questions > 0", "human", "rhetorical questions", "questions"),
    ("exclamations > 0", "human", "expressive punctuation", "exclamations"),
]
TRENDS = rf"""
WITH {BASE},
k AS (
  SELECT doc_id, count(*) AS s, round(stddev_pop(n) / avg(n), 9) AS cv, count(*) FILTER (s LIKE '%?') AS questions, count(*) FILTER (s LIKE '%!') AS exclamations, string_agg(s, ' ' ORDER BY no) AS joined FROM sent GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(regexp_extract_all(lower(joined), '[^{WS}]+')) AS w FROM k),
rp AS (SELECT doc_id, sum(c) AS n, count(*) FILTER (c >= 3 AND length(w) + len(regexp_extract_all(w, '[\x{{10000}}-\x{{10FFFF}}]')) > 4) AS repeated FROM (SELECT doc_id, w, count(*) AS c FROM wd GROUP BY ALL) GROUP BY doc_id),
x AS (
  SELECT k.*, n, repeated, len(list_filter(string_split_regex(joined, '\n[{WS}]*\n'), lambda p: {trimmed("p")} <> '')) AS paragraphs, {_in("lower(joined)", L.STOCK_TRANSITIONS)} AS phrases,
    len(regexp_extract_all(lower(joined), {_re2(L.FIRST_PERSON)})) AS first, len(regexp_extract_all(lower(joined), '[a-z0-9_]+''[a-z0-9_]+')) AS contractions
  FROM k JOIN rp USING (doc_id)),
t AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS i, {_q(kind)} AS kind, {_q(trend)} AS trend, ({value})::DOUBLE AS v FROM x WHERE {when}" for i, (when, kind, trend, value) in enumerate(_RULES))})
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS rank, kind, trend, {_R("v")} AS value FROM t"""

_PAIRS = [(j, k) for j in range(WINDOW) for k in range(j + 1, WINDOW)]
_GRAPH = rf"""
{BASE},
c AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM tok WHERE length(w) > 3 AND w NOT IN ({", ".join(map(_q, C.STOP_WORDS))}) AND doc_id IN (SELECT doc_id FROM tok GROUP BY doc_id HAVING count(*) >= {LEAST_TOKENS})),
wi AS (SELECT *, {", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(WINDOW))} FROM c),
pr AS ({" UNION ALL ".join(f"SELECT doc_id, i * {len(_PAIRS)} + {t} AS o, least(w{j}, w{k}) AS a, greatest(w{j}, w{k}) AS b FROM wi WHERE i < n - {WINDOW} AND w{j} <> w{k}" for t, (j, k) in enumerate(_PAIRS))}),
e AS (SELECT doc_id, a, b, count(*) AS weight, min(o) AS o FROM pr GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, o) AS rank FROM e QUALIFY rank <= {EDGES}),
nd AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY min(z)) AS rank
  FROM (SELECT doc_id, a AS w, 2 * rank AS z FROM top UNION ALL SELECT doc_id, b, 2 * rank + 1 FROM top) GROUP BY doc_id, w QUALIFY rank <= {NODES})"""
EDGES_SQL = rf"""
WITH {_GRAPH}
SELECT top.doc_id, top.rank::BIGINT AS rank, a AS word, b AS other, weight::BIGINT AS weight, x.w IS NOT NULL AND y.w IS NOT NULL AS drawn
FROM top LEFT JOIN nd x ON x.doc_id = top.doc_id AND x.w = a LEFT JOIN nd y ON y.doc_id = top.doc_id AND y.w = b"""
NODES_SQL = rf"""
WITH {_GRAPH}
SELECT nd.doc_id, nd.rank::BIGINT AS rank, nd.w AS word, sum(weight)::BIGINT AS degree FROM nd JOIN e ON e.doc_id = nd.doc_id AND (a = nd.w OR b = nd.w) GROUP BY ALL"""

_GRAM = lambda n: " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER o" for k in range(1, n)])
REPETITION_MAP = rf"""
WITH {BASE},
g AS ({" UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, {n} AS n, pos - 1 AS p, {_GRAM(n)} AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE g IS NOT NULL" for n in (2, 3, 4, 5))}),
r AS (SELECT doc_id, n, p, count(*) OVER (PARTITION BY doc_id, n, g) AS c, count(*) OVER (PARTITION BY doc_id, n) AS total FROM g),
h AS (SELECT doc_id, n, p * {SEGMENTS} // total AS seg, count(*) AS k FROM r WHERE c > 1 GROUP BY ALL),
z AS (SELECT doc_id, n::INT AS n, s::INT AS seg FROM d, (VALUES (2), (3), (4), (5)) v(n), range({SEGMENTS}) q(s))
SELECT z.doc_id, z.n, z.seg AS segment, coalesce(k, 0)::BIGINT AS repeats, {_R(f"least(1, coalesce(k, 0) / {FULL})")} AS intensity FROM z LEFT JOIN h ON h.doc_id = z.doc_id AND h.n = z.n AND h.seg = z.seg"""

HISTOGRAM = rf"""
WITH {BASE},
k AS (SELECT doc_id, len({_WS_WORDS}) AS n FROM sent),
m AS (SELECT doc_id, min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi, CASE WHEN max(n) > min(n) THEN (max(n) - min(n)) / {BINS} ELSE 1 END AS w FROM k GROUP BY doc_id),
b AS (SELECT doc_id, i, lo + i * w AS a, lo + (i + 1) * w AS z, hi FROM m, range({BINS}) t(i))
SELECT b.doc_id, i::INT AS bin, floor(a + 0.5)::BIGINT AS low, floor(z + 0.5)::BIGINT AS high, floor((a + z) / 2 + 0.5)::BIGINT AS centre,
  (count(*) FILTER (n >= a AND n < z) + CASE WHEN i = {BINS - 1} THEN count(*) FILTER (n = hi) ELSE 0 END)::BIGINT AS n
FROM b JOIN k USING (doc_id) GROUP BY b.doc_id, i, a, z"""
