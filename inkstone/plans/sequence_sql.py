"""DuckDB SQL of the sequence statistics, from rows by word in place of arrays."""

from __future__ import annotations

from inkstone.functions.lexicons import FUNCTION_WORDS
from inkstone.functions.segment import WS
from inkstone.plans.lexical_sql import _q
from inkstone.plans.oracles import trimmed

_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
_STD = lambda n, s, q: f"sqrt({n} * {q} - {s} * {s}) / {n}"
_ASTRAL = r"len(regexp_extract_all({0}, '[\x{{10000}}-\x{{10FFFF}}]'))"
_WORDS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tok AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\b[a-z''-]+\b') AS ws FROM d)),
nw AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(length(w))::DOUBLE AS s, sum(length(w) * length(w))::DOUBLE AS q FROM tok GROUP BY doc_id),
new AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) = 1 AS is_new FROM tok),
grow AS (
  SELECT doc_id, pos, u FROM (SELECT doc_id, pos, sum(is_new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS u FROM new) JOIN nw USING (doc_id)
  WHERE pos % 50 = 0 OR pos = n)"""

GROWTH = f"WITH {_WORDS} SELECT doc_id, pos::BIGINT AS position, u::BIGINT AS n_types FROM grow"


def _skew(rows: str, x: str, n: str, m: str, sd: str) -> str:
    return f"(SELECT doc_id, sum(pow(({x} - {m}) / {sd}, 3)) * any_value({n}) / ((any_value({n}) - 1) * (any_value({n}) - 2)) AS z FROM {rows} WHERE {n} >= 3 AND {sd} > 0 GROUP BY doc_id)"


SEQUENCES = rf"""
WITH {_WORDS},
cnt AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY ALL),
rk AS (SELECT doc_id, c, ln(row_number() OVER (PARTITION BY doc_id ORDER BY c DESC)) AS x, ln(c) AS y FROM cnt),
voc AS (
  SELECT doc_id, count(*) AS v, max(c) = min(c) AS even, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM rk GROUP BY doc_id),
bits AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM cnt JOIN nw USING (doc_id) GROUP BY doc_id),
ch AS (
  SELECT doc_id, k, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[{WS}]', '', 'g'), '(?s).')) AS k FROM d) GROUP BY ALL),
chn AS (SELECT doc_id, sum(c * CASE WHEN unicode(k) > 65535 THEN 2 ELSE 1 END) AS n FROM ch GROUP BY doc_id),
chb AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM ch JOIN chn USING (doc_id) GROUP BY doc_id),
pr AS (
  SELECT doc_id, a, b, count(*) AS c FROM (SELECT doc_id, w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok) WHERE b IS NOT NULL GROUP BY ALL),
st AS (SELECT doc_id, a, c, sum(c) OVER (PARTITION BY doc_id, a) AS t, sum(c) OVER (PARTITION BY doc_id) AS m FROM pr),
ent AS (SELECT doc_id, -sum(c / m * log2(c / m)) AS h2 FROM st GROUP BY doc_id),
tr AS (SELECT doc_id, avg(h) AS h FROM (SELECT doc_id, a, -sum(c / t * log2(c / t)) AS h FROM st GROUP BY doc_id, a) GROUP BY doc_id),
gap AS (SELECT doc_id, w, pos - lag(pos) OVER (PARTITION BY doc_id, w ORDER BY pos) AS g FROM tok),
by_word AS (SELECT doc_id, w, count(*)::DOUBLE AS k, sum(g)::DOUBLE AS s, sum(g * g)::DOUBLE AS q FROM gap WHERE g IS NOT NULL GROUP BY ALL),
back AS (
  SELECT doc_id, avg(({_STD("k", "s", "q")} - s / k) / ({_STD("k", "s", "q")} + s / k)) AS burst, sum(s) / sum(k) AS m, {_STD("sum(k)", "sum(s)", "sum(q)")} AS sd FROM by_word GROUP BY doc_id),
con AS (
  SELECT doc_id, count(*)::DOUBLE AS k, sum(g)::DOUBLE AS s, sum(g * g)::DOUBLE AS q
  FROM (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM tok WHERE length(w) > 3 AND w NOT IN ({", ".join(map(_q, sorted(set(FUNCTION_WORDS))))})) WHERE g IS NOT NULL GROUP BY doc_id),
par AS (SELECT doc_id, unnest(string_split_regex(text, '\n[{WS}]*\n')) AS p FROM d),
den AS (SELECT doc_id, len(regexp_extract_all(' ' || lower(p) || ' ', '\b[a-z]{{5,}}\b')) / greatest(length(p) + {_ASTRAL.format("p")}, 1) AS x FROM par),
dm AS (SELECT doc_id, x, avg(x) OVER (PARTITION BY doc_id) AS m FROM den),
top AS (SELECT doc_id, CASE WHEN count(*) >= 2 THEN sqrt(sum((x - m) * (x - m)) / count(*)) / greatest(any_value(m), 0.001) ELSE 0 END AS b FROM dm GROUP BY doc_id),
se AS (
  SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z0-9_]+')) AS l FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+[{WS}]+')) AS s FROM d) WHERE {trimmed("s")} <> ''),
sn AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(l)::DOUBLE AS s, sum(l * l)::DOUBLE AS q FROM se GROUP BY doc_id),
sb AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, l, count(*) AS c FROM se GROUP BY ALL) JOIN sn USING (doc_id) GROUP BY doc_id),
ssk AS {_skew("(SELECT se.doc_id, l, n, s / n AS m, " + _STD("n", "s", "q") + " AS sd FROM se JOIN sn USING (doc_id))", "l", "n", "m", "sd")},
lsk AS {_skew("(SELECT tok.doc_id, length(w) AS l, n, s / n AS m, " + _STD("n", "s", "q") + " AS sd FROM tok JOIN nw USING (doc_id))", "l", "n", "m", "sd")},
hp AS (SELECT doc_id, count(*) AS k, regr_slope(ln(u), ln(pos)) AS beta, regr_intercept(ln(u), ln(pos)) AS b0 FROM grow GROUP BY doc_id),
lag AS (
  SELECT doc_id, sum((l - m) * (l2 - m)) AS s FROM (
    SELECT tok.doc_id, length(w) AS l, length(lead(w) OVER (PARTITION BY tok.doc_id ORDER BY pos)) AS l2, s / n AS m FROM tok JOIN nw USING (doc_id)) WHERE l2 IS NOT NULL GROUP BY doc_id),
cum AS (
  SELECT doc_id, max(c) - min(c) AS span FROM (SELECT tok.doc_id, sum(n * length(w) - s) OVER (PARTITION BY tok.doc_id ORDER BY pos) AS c FROM tok JOIN nw USING (doc_id)) GROUP BY doc_id),
j AS (
  SELECT d.doc_id, coalesce(nw.n, 0) AS n, nw.s, nw.q, coalesce(nw.n, 0) >= 10 AND v > 1 AS ranked, even, slope, r2, bits.h AS wb, chb.h AS cb, h2, sb.h AS sb, burst, back.m AS gm, back.sd AS gs, {_STD("con.k", "con.s", "con.q")} AS cs, top.b AS tb,
    sn.n AS sn, sn.s AS ss, sn.q AS sq, ssk.z AS sz, lsk.z AS lz, hp.k AS hk, beta, b0, tr.h AS th, lag.s AS ls, span, nw.s / nw.n AS m, {_STD("nw.n", "nw.s", "nw.q")} AS sd
  FROM d LEFT JOIN nw USING (doc_id) LEFT JOIN voc USING (doc_id) LEFT JOIN bits USING (doc_id) LEFT JOIN chb USING (doc_id) LEFT JOIN ent USING (doc_id) LEFT JOIN tr USING (doc_id) LEFT JOIN back USING (doc_id)
  LEFT JOIN con USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN sn USING (doc_id) LEFT JOIN sb USING (doc_id) LEFT JOIN ssk USING (doc_id) LEFT JOIN lsk USING (doc_id) LEFT JOIN hp USING (doc_id) LEFT JOIN lag USING (doc_id) LEFT JOIN cum USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words,
  {_R("CASE WHEN ranked THEN slope ELSE 0 END")} AS zipf_slope, {_R("CASE WHEN ranked AND NOT even THEN r2 ELSE 0 END")} AS zipf_r2,
  {_R("coalesce(wb, 0)")} AS word_bits, {_R("coalesce(cb, 0)")} AS letter_bits, {_R("coalesce(h2, 0)")} AS pair_bits, {_R("greatest(0, coalesce(h2, 0) - coalesce(wb, 0))")} AS conditional_bits, {_R("coalesce(wb, 0) * 1.1")} AS cross_bits,
  {_R("coalesce(sb, 0)")} AS sentence_bits, {_R("coalesce(burst, 0)")} AS return_burstiness, {_R("coalesce(gm, 0)")} AS return_mean, {_R("coalesce(gs, 0)")} AS return_std, {_R("coalesce(cs, 0)")} AS content_spread, {_R("coalesce(tb, 0)")} AS topic_burstiness,
  {_R("coalesce(m, 0)")} AS length_mean, {_R("coalesce(sd, 0)")} AS length_std, {_R("coalesce(lz, 0)")} AS length_skewness,
  {_R("coalesce(ss / sn, 0)")} AS sentence_mean, {_R("coalesce(" + _STD("sn", "ss", "sq") + ", 0)")} AS sentence_std, {_R("coalesce(sz, 0)")} AS sentence_skewness,
  {_R("CASE WHEN hk >= 2 THEN exp(b0) ELSE 0 END")} AS heaps_k, {_R("CASE WHEN hk >= 2 THEN beta ELSE 0 END")} AS heaps_beta, {_R("coalesce(th, 0)")} AS transition_bits,
  {_R("CASE WHEN n >= 10 AND sd > 0 THEN ls / ((n - 1) * sd * sd) ELSE 0 END")} AS length_lag1, {_R("CASE WHEN n >= 20 AND sd > 0 THEN ln(span / n / sd) / ln(n) ELSE 0.5 END")} AS hurst
FROM j"""
