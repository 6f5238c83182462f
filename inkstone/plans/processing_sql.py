"""DuckDB SQL of reading difficulty and coherence."""

from __future__ import annotations

from inkstone.functions import processing_lists as L
from inkstone.functions.lexicons import FUNCTION_WORDS
from inkstone.functions.segment import WS
from inkstone.operators.processing import FLOOR
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import BASE, trimmed

_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
_N = lambda column, pattern: f"len(regexp_extract_all({column}, {_re2(pattern)}))"
_STOP = ", ".join(map(_q, sorted(set(FUNCTION_WORDS))))

DIFFICULTY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
se AS (SELECT * FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+[{WS}]+')) AS s FROM d) WHERE {trimmed("s")} <> ''),
sc AS (
  SELECT doc_id, count(*)::DOUBLE AS n, sum({_N("s", L.CLAUSES)}) AS clauses, max({_N("s", L.DEEP_CLAUSES)}) AS depth, count(*) FILTER ({_N("s", L.EMBEDDED)} >= 2) AS embedded,
    count(*) FILTER ({_N("s", L.GARDEN_PATHS[0])} > 0) + count(*) FILTER ({_N("lower(s)", L.GARDEN_PATHS[1])} > 0) AS garden,
    count(*) FILTER (len(string_split_regex(s, '[{WS}]+')) > 20 AND {_N("s", L.SUBJECTS)} >= 2 AND {_N("s", L.VERBS)} >= 2) AS far,
    sum({_N("s", L.VAGUE_PRONOUNS)}) * 0.1 + sum({_N("s", L.POLYSEMOUS)}) * 0.2 AS vague, sum({_N("s", L.PROPOSITIONS)}) AS verbs,
    sum(len(list_filter(regexp_extract_all(lower(s), '[a-z0-9_]+'), lambda w: w NOT IN ({_STOP})))) AS load
  FROM se GROUP BY doc_id),
wc AS (
  SELECT doc_id, count(*)::DOUBLE AS k, count(*) FILTER (w NOT IN ({_STOP})) AS content, count(*) FILTER (w NOT IN ({_STOP}) AND length(w) > 2) AS lexical
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b[a-z''-]+\b')) AS w FROM d) GROUP BY doc_id),
rs AS (SELECT doc_id, unnest(range(len(ss))) AS no, unnest(ss) AS s FROM (SELECT doc_id, string_split_regex(text, '[.!?]+') AS ss FROM d)),
rw AS (SELECT doc_id, no, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, no, string_split_regex(s, '[{WS}]+') AS ws FROM rs)),
rl AS (SELECT *, max(CASE WHEN regexp_matches(w, {_q(L.NAME)}) THEN i END) OVER (PARTITION BY doc_id, no ORDER BY i ROWS UNBOUNDED PRECEDING) AS noun FROM rw),
rf AS (SELECT doc_id, avg(i - noun) AS x FROM rl WHERE noun IS NOT NULL AND regexp_matches(w, {_re2(L.REFERENCE)}) GROUP BY doc_id),
pa AS (SELECT doc_id, unnest(range(len(ps))) AS i, len(ps) AS n, list_distinct(list_transform(regexp_extract_all(unnest(ps), {_re2(L.NAMES)}), lambda x: lower(x))) AS names FROM (SELECT doc_id, string_split_regex(text, '\n[{WS}]*\n') AS ps FROM d)),
sh AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (before IS NOT NULL AND len(list_intersect(before, names)) < 2) AS k FROM (SELECT *, lag(names) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM pa) GROUP BY doc_id),
x AS (
  SELECT d.*, coalesce(n, 0) AS ns, greatest(coalesce(n, 0), 1) AS n, clauses, depth, embedded, garden, far, vague, verbs, load, greatest(coalesce(k, 0), 1) AS k, content, lexical, rf.x AS distance, greatest(len(regexp_extract_all(text, '[A-Za-z0-9_]+')), 1) AS words,
    {_N("text", L.SIMPLE_NEGATIONS)} AS simple, {_N("text", L.DOUBLE_NEGATIONS)} AS twice, {_N("text", L.IMPLICIT_NEGATIONS)} AS implicit, {_N("text", L.PRONOUNS)} AS pronouns, {_N("text", L.NAMES)} AS names
  FROM d LEFT JOIN sc USING (doc_id) LEFT JOIN wc USING (doc_id) LEFT JOIN rf USING (doc_id))
SELECT x.doc_id, {_R("(coalesce(clauses, 0) + ns) / x.n")} AS parse_depth, coalesce(garden, 0)::BIGINT AS garden_paths, coalesce(embedded, 0)::BIGINT AS center_embedded, coalesce(far, 0)::BIGINT AS long_dependencies, {_R("coalesce(vague, 0) / x.n")} AS ambiguity,
  simple::BIGINT AS simple_negations, twice::BIGINT AS double_negations, implicit::BIGINT AS implicit_negations, (simple + 2 * twice + implicit)::BIGINT AS negation_complexity, {_R("coalesce(content, 0) / x.k")} AS content_ratio, {_R("coalesce(verbs, 0) / x.n")} AS proposition_density,
  {_R(f"({_N('text', L.NOUN_ENDINGS)} + {_N('text', L.VERB_ENDINGS)}) / words")} AS idea_density, {_R(f"{_N('text', L.ABSTRACT_ENDINGS)} / words")} AS concept_density, {_R("coalesce(lexical, 0) / x.k")} AS lexical_density, {_R("coalesce(load, 0) / x.n")} AS information_load,
  coalesce(depth, 0)::BIGINT AS clause_depth, {_R("CASE WHEN names = 0 THEN CASE WHEN pronouns > 5 THEN 1 ELSE 0 END ELSE least(1, pronouns / (names * 2)) END")} AS pronoun_difficulty, {_R("coalesce(distance, 0)")} AS referent_distance,
  {_R("sh.k / greatest(sh.n - 1, 1)")} AS topic_shifts, {_R(f"{_N('text', L.ENTITIES)} / words")} AS entity_density
FROM x JOIN sh USING (doc_id)"""

_SHARES = "SELECT doc_id, w, count(*) FILTER (pos <= h) / greatest(any_value(h), 1) AS p, count(*) FILTER (pos > h) / greatest(any_value(n) - any_value(h), 1) AS q FROM hv GROUP BY doc_id, w"
COHERENCE = rf"""
WITH {BASE},
vc AS (SELECT doc_id, no, w, count(*) AS c FROM (SELECT doc_id, no, unnest(regexp_extract_all(lower(s), '[a-z0-9_''-]+')) AS w FROM sent) GROUP BY ALL),
nm AS (SELECT doc_id, no, sqrt(sum(c * c)) AS z FROM vc GROUP BY ALL),
dt AS (SELECT a.doc_id, a.no, sum(a.c * b.c) AS k FROM vc a JOIN vc b ON a.doc_id = b.doc_id AND b.no = a.no + 1 AND a.w = b.w GROUP BY ALL),
ns AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id),
cs AS (
  SELECT s.doc_id, coalesce(k / (x.z * y.z), 0) AS c FROM sent s JOIN ns USING (doc_id) LEFT JOIN dt ON dt.doc_id = s.doc_id AND dt.no = s.no LEFT JOIN nm x ON x.doc_id = s.doc_id AND x.no = s.no LEFT JOIN nm y ON y.doc_id = s.doc_id AND y.no = s.no + 1
  WHERE s.no < ns.n),
ca AS (SELECT doc_id, avg(c) AS m, var_pop(c) AS v FROM cs GROUP BY doc_id),
hv AS (SELECT doc_id, w, pos, count(*) OVER (PARTITION BY doc_id) AS n, floor(count(*) OVER (PARTITION BY doc_id) / 2) AS h FROM tok),
js AS (
  SELECT doc_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js, sum(greatest({FLOOR}, p) * ln(greatest({FLOOR}, p) / greatest({FLOOR}, q))) AS kl
  FROM ({_SHARES}) GROUP BY doc_id),
hc AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
ow AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM d),
oc AS (SELECT doc_id, count(*)::DOUBLE AS k, count(*) FILTER (w IN ({", ".join(map(_q, L.REFERRING))})) AS refs FROM ow GROUP BY doc_id),
lc AS (SELECT doc_id, count(*) FILTER (c > 1) / count(*) AS x FROM (SELECT doc_id, w, count(*) AS c FROM ow WHERE length(w) > 4 GROUP BY ALL) GROUP BY doc_id),
th AS (SELECT sent.doc_id, (no - 1) // (ns.n // 3) AS part, string_agg(s, ' ' ORDER BY no) AS t FROM sent JOIN ns USING (doc_id) WHERE ns.n >= 3 GROUP BY ALL),
tv AS (SELECT doc_id, part, list_distinct(regexp_extract_all(lower(t), '\b[a-z]+\b')) AS v FROM th WHERE part < 3),
tj AS (SELECT a.doc_id, 1 - avg(CASE WHEN len(a.v) + len(b.v) > 0 THEN len(list_intersect(a.v, b.v)) / len(list_distinct(list_concat(a.v, b.v))) ELSE 0 END) AS x FROM tv a JOIN tv b ON a.doc_id = b.doc_id AND b.part = a.part + 1 GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(ns.n, 0)::BIGINT AS n_sentences, {_R("coalesce(m, 0)")} AS mean_similarity, {_R("coalesce(v, 0)")} AS similarity_variance,
  {_R("CASE WHEN coalesce(ns.n, 0) < 3 THEN 0.5 ELSE 1 - greatest(0, least(1, round(v, 12) / 0.1)) END")} AS evenness, {_R("CASE WHEN hc.n >= 2 THEN js ELSE 0 END")} AS halves_js, {_R("CASE WHEN hc.n >= 2 THEN kl ELSE 0 END")} AS halves_kl,
  {_R("CASE WHEN oc.k >= 30 AND ns.n >= 3 THEN tj.x ELSE 0 END")} AS topic_drift, {_R("CASE WHEN oc.k >= 30 AND ns.n >= 3 THEN coalesce(lc.x, 0) ELSE 0 END")} AS lexical_chains, {_R("CASE WHEN oc.k >= 30 AND ns.n >= 3 THEN refs * 100 / oc.k ELSE 0 END")} AS pronoun_density
FROM d LEFT JOIN ns USING (doc_id) LEFT JOIN ca USING (doc_id) LEFT JOIN js USING (doc_id) LEFT JOIN hc USING (doc_id) LEFT JOIN oc USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN tj USING (doc_id)"""
