"""DuckDB SQL of the signals of rewritten texts, from rows by word and sentence."""

from __future__ import annotations

from inkstone.functions import signal_lists as L
from inkstone.functions.segment import WS
from inkstone.operators.rewriting_signals import FEATURES
from inkstone.plans.category_sql import _in
from inkstone.plans.lexical_sql import _q
from inkstone.plans.oracles import trimmed

_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
_ONE = lambda x: f"least(1, {x})"
_EVERY = [x for words in L.FINER_WORDS.values() for x in words]
_TWICE = sorted({x for x in _EVERY if _EVERY.count(x) > 1})
_LIST = lambda words: ", ".join(map(_q, sorted(set(words))))
_APOSTROPHE = "'[a-z0-9_]+''[a-z0-9_]+'"


def _corr(rows: str) -> str:
    return f"""(SELECT doc_id, count(*) AS c, CASE WHEN count(*) >= 2 AND sqrt(var_pop(x) * var_pop(y)) * count(*) > 0.0001 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END AS r FROM {rows} GROUP BY doc_id)"""


def _entropy(rows: str, key: str) -> str:
    return f"(SELECT doc_id, count(*) AS c, -sum(z / n * ln(z / n)) AS h FROM (SELECT doc_id, z, sum(z) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, {key}, count(*) AS z FROM {rows} GROUP BY ALL)) GROUP BY doc_id)"


def _again(n: int) -> str:
    gram = " || '_' || ".join(["w"] + [f"lead(w, {k}) OVER o" for k in range(1, n)])
    return f"(SELECT doc_id, count(*) FILTER (k > 1) AS r FROM (SELECT doc_id, g, count(*) AS k FROM (SELECT doc_id, {gram} AS g FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE g IS NOT NULL GROUP BY ALL) GROUP BY doc_id)"


_HALF = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE 0.5 END"
_VALUES = {
    "variance_of_variance": _ONE("loc.s * loc.s / (z.v + 1)"),
    "variance_stability": "1 - " + _ONE("loc.s / (loc.m + 0.1)"),
    "local_variance_consistency": _HALF("loc.c > 2", "1 - " + _ONE("loc.s / (loc.m + 0.1)")),
    "autocorr_decay_rate": _HALF("z.n >= 5 AND z.v >= 0.01", "greatest(0, least(1, (ac[1] - ac[-1]) / len(ac) + 0.5))"),
    "autocorr_flatness": "CASE WHEN z.n < 5 THEN 0.5 WHEN z.v < 0.01 THEN 1 ELSE 1 - least(1, list_var_pop(ac) * 10) END",
    "autocorr_periodicity": "CASE WHEN z.n < 5 THEN 0.5 WHEN z.v < 0.01 OR len(ac) < 3 THEN 0 ELSE len(list_filter(range(1, len(ac)), lambda i: ac[i] * ac[i + 1] < 0)) / (len(ac) - 1) END",
    "length_complexity_corr": "lcc",
    "vocab_structure_corr": _HALF("z.n >= 5 AND vs.c >= 3", "(vs.r + 1) / 2"),
    "feature_correlation_breaks": _HALF("z.n >= 5", "abs(CASE WHEN round(lcc, 9) = 0 THEN 0.5 ELSE round(lcc, 9) END - 0.8)"),
    "synonym_cluster_usage": "(plain + fine) / nw",
    "rare_synonym_ratio": "CASE WHEN plain + fine > 0 THEN fine / (plain + fine) ELSE 0 END",
    "sophistication_jumps": "CASE WHEN jmp.c > 2 THEN jmp.m / 15 ELSE 0 END",
    "contraction_rate": "cr",
    "contraction_uniformity": "cu",
    "artificial_contraction_score": "CASE WHEN round(cr, 9) > 0.3 AND round(cu, 9) > 0.7 THEN (cr + cu) / 2 ELSE 0 END",
    "sentence_start_diversity": _HALF("sta.c > 0", "sta.d / sta.c"),
    "structure_template_score": "sig.r / z.n",
    "parallelism_score": "par.p / (z.n - 1)",
    "sophistication_variance": _HALF("sop.c >= 3", _ONE("sop.v / 4")),
    "sophistication_autocorr": _HALF("sop.c >= 4", "(soa.r + 1) / 2"),
    "word_choice_consistency": _HALF("ten.c > 2", "1 - " + _ONE("ten.s * 5")),
    "bigram_predictability": "coalesce(g2.r, 0) / (nw - 1)",
    "trigram_predictability": "coalesce(g3.r, 0) / (nw - 2)",
    "ngram_surprise_variance": _ONE("sur.v / 2"),
    "comma_density": _ONE("len(regexp_extract_all(text, ',')) / (tw / 10)"),
    "punctuation_variety": _ONE(f"len(list_distinct(regexp_extract_all(text, '[^A-Za-z0-9_{WS}]'))) / 8"),
    "punctuation_position_entropy": _HALF("com.k >= 3", _ONE("com.h / 1.4")),
    "transition_density": _ONE("trans / (z.n / 3 + 0.1)"),
    "hedging_density": _ONE("hedge / (z.n / 5 + 0.1)"),
    "discourse_marker_variety": _HALF("trans > 0", "1"),
    "word_length_variance": _ONE("wl.v / 10"),
    "word_length_entropy": _ONE("wle.h / 3"),
    "long_word_clustering": _HALF("far.c >= 2", "1 - " + _ONE("far.v / 50")),
    "lexical_entropy": "lex.h / ln(lex.c + 1)",
    "sentence_entropy": "sen.h / ln(sen.c + 1)",
    "entropy_stability": _HALF("hal.c > 2", "1 - " + _ONE("hal.s * 2")),
}
_SEEN = lambda k: f"(CASE WHEN {k} = 0 THEN 0.5 ELSE {k} END)"
_SCORE = " + ".join(f"{_SEEN(k)} * {w}" if w > 0 else f"(1 - {_SEEN(k)}) * {-w}" for k, w in L.SIGNAL_WEIGHTS.items())
_JOINS = "loc vs jmp sta sig par sop soa ten g2 g3 sur com wl wle far lex sen hal".split()

SIGNALS = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, {trimmed(f"regexp_replace(coalesce(text, ''), '[{WS}]+', ' ', 'g')")} AS flat FROM documents),
e AS (
  SELECT doc_id, text, low, regexp_extract_all(low, '\b[a-z]+\b') AS ws,
    list_filter(string_split(regexp_replace(flat, '([.!?])[{WS}]+', '\1' || chr(2), 'g'), chr(2)), lambda s: length({trimmed("s")}) > 5) AS ss FROM a),
b AS (SELECT *, len(ws)::DOUBLE AS nw, len(ss)::DOUBLE AS n FROM e WHERE length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')) >= 100 AND len(ws) >= 30 AND len(ss) >= 3),
tok AS (SELECT doc_id, nw, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM b),
sw AS (SELECT doc_id, n, no, s, regexp_extract_all(lower(s), '\b[a-z]+\b') AS sw FROM (SELECT doc_id, n, unnest(range(len(ss))) AS no, unnest(ss) AS s FROM b)),
k AS (SELECT *, len(sw)::DOUBLE AS k, length(array_to_string(sw, ''))::DOUBLE AS letters FROM sw),
ks AS (SELECT doc_id, list(k ORDER BY no) AS ks, avg(k) AS m, var_pop(k) AS v FROM k GROUP BY doc_id),
kw AS (SELECT ks.*, n, greatest(3, floor(n / 4))::BIGINT AS wd FROM ks JOIN b USING (doc_id)),
lo AS (SELECT doc_id, unnest(list_transform(range(0, (n - wd + 1)::BIGINT), lambda i: list_var_pop(ks[i + 1:i + wd]))) AS x FROM kw),
loc AS (SELECT doc_id, count(*) AS c, avg(x) AS m, stddev_pop(x) AS s FROM lo GROUP BY doc_id),
au AS (
  SELECT doc_id, v, CASE WHEN v >= 0.01 THEN list_transform(range(1, least(5, floor(n / 2))::BIGINT + 1), lambda j: list_sum(list_transform(range(1, n::BIGINT - j + 1), lambda i: (ks[i] - m) * (ks[i + j] - m))) / (n - j) / v) END AS ac FROM kw),
cx AS (SELECT doc_id, k AS x, len(list_filter(sw, lambda t: length(t) > 6)) / k AS y FROM k WHERE k > 0),
lc AS {_corr("cx")},
ch AS (
  SELECT doc_id, no, n, list_concat(list_concat(sw, lead(sw) OVER o), lead(sw, 2) OVER o) AS w, k AS k0, lead(k) OVER o AS k1, lead(k, 2) OVER o AS k2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
cv AS (SELECT doc_id, len(list_distinct(w)) / len(w) AS x, list_stddev_pop([k0, k1, k2]) / (len(w) / 3 + 0.1) AS y FROM ch WHERE no <= n - 3 AND len(w) > 0),
vs AS {_corr("cv")},
fv AS (SELECT doc_id, pos, nw, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM tok),
fj AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM fv WHERE pos % 5 = 0 AND pos < nw - 5),
jmp AS (SELECT doc_id, count(*) AS c, avg(abs(y - x)) AS m FROM fj GROUP BY doc_id),
sta AS (SELECT doc_id, count(sw[1]) AS c, count(DISTINCT sw[1]) AS d FROM k GROUP BY doc_id),
sig AS (SELECT doc_id, count(*) FILTER (c > 1) AS r FROM (SELECT doc_id, array_to_string(list_transform(sw[1:3], lambda t: t[1]), '_') AS g, count(*) AS c FROM k GROUP BY ALL) GROUP BY doc_id),
par AS (SELECT doc_id, count(*) FILTER (abs(k - k2) <= 2) AS p FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY no) AS k2 FROM k) GROUP BY doc_id),
so AS (SELECT doc_id, no, letters / k AS x FROM k WHERE k > 0),
sop AS (SELECT doc_id, count(*) AS c, var_pop(x) AS v FROM so GROUP BY doc_id),
soa AS {_corr("(SELECT * FROM (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY no) AS y FROM so) WHERE y IS NOT NULL)")},
tn AS (SELECT doc_id, len(list_distinct(ws[i + 1:i + 10])) / 10 AS x FROM (SELECT doc_id, ws, unnest(range(0, greatest(nw - 10, 0)::BIGINT, 10)) AS i FROM b)),
ten AS (SELECT doc_id, count(*) AS c, stddev_pop(x) AS s FROM tn GROUP BY doc_id),
g2 AS {_again(2)},
g3 AS {_again(3)},
pr AS (SELECT doc_id, pos, w AS x, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM tok),
pc AS (SELECT doc_id, pos, -ln(count(*) OVER (PARTITION BY doc_id, x, y) / count(*) OVER (PARTITION BY doc_id, x) + 0.01) AS s FROM pr WHERE y IS NOT NULL),
sur AS (SELECT doc_id, var_pop(s) AS v FROM pc WHERE pos > 0 GROUP BY doc_id),
cp AS (SELECT doc_id, unnest(list_filter(list_transform(qs, lambda x, i: CASE WHEN contains(x, ',') THEN least(3, (i - 1) * 4 // len(qs)) END), lambda x: x IS NOT NULL)) AS q FROM (SELECT doc_id, string_split_regex(s, '[{WS}]+') AS qs FROM sw)),
com AS (SELECT * FROM {_entropy("cp", "q")} JOIN (SELECT doc_id, count(*) AS k FROM cp GROUP BY doc_id) USING (doc_id)),
wl AS (SELECT doc_id, var_pop(length(w)) AS v FROM tok GROUP BY doc_id),
wle AS {_entropy("tok", "length(w)")},
fr AS (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM tok WHERE length(w) >= 8),
far AS (SELECT doc_id, count(*) AS c, var_pop(g) AS v FROM fr GROUP BY doc_id),
lex AS {_entropy("tok", "w")},
sen AS {_entropy("k", "k")},
hx AS (SELECT doc_id, i, unnest(ws[i + 1:i + 20]) AS w FROM (SELECT doc_id, ws, unnest(range(0, greatest(nw - 20, 0)::BIGINT, 10)) AS i FROM b)),
he AS (SELECT doc_id, i, -sum(c / 20 * ln(c / 20)) AS h FROM (SELECT doc_id, i, w, count(*) AS c FROM hx GROUP BY ALL) GROUP BY doc_id, i),
hal AS (SELECT doc_id, count(*) AS c, stddev_pop(h) AS s FROM he GROUP BY doc_id),
cs AS (SELECT doc_id, avg(c) AS m, stddev_pop(c) AS s FROM (SELECT doc_id, len(regexp_extract_all(lower(s), {_APOSTROPHE})) AS c FROM sw) GROUP BY doc_id),
x AS (
  SELECT b.*, au.v, ac, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS tw, len(regexp_extract_all(low, {_APOSTROPHE})) AS nc, cs.m AS cm, cs.s AS csd, {_in("low", L.TRANSITION_MARKERS)} AS trans, {_in("low", L.HEDGING_PHRASES)} AS hedge,
    len(list_filter(ws, lambda t: t IN ({_LIST(L.FINER_WORDS)}))) AS plain, len(list_filter(ws, lambda t: t IN ({_LIST(_EVERY)}))) + len(list_filter(ws, lambda t: t IN ({_LIST(_TWICE)}))) AS fine,
    CASE WHEN n >= 5 AND lc.c >= 5 THEN (lc.r + 1) / 2 ELSE 0.5 END AS lcc
  FROM b JOIN au USING (doc_id) LEFT JOIN cs USING (doc_id) LEFT JOIN lc USING (doc_id)),
z AS (SELECT *, {_ONE("nc * 20 / tw")} AS cr, {_HALF("nc >= 2 AND cm > 0", "1 - " + _ONE("csd / (cm + 0.1)"))} AS cu FROM x),
f AS (SELECT z.doc_id, {", ".join(f"round(({_VALUES[k]})::DOUBLE, 9) AS {k}" for k in FEATURES)} FROM z {" ".join(f"LEFT JOIN {t} ON {t}.doc_id = z.doc_id" for t in _JOINS)}),
p AS (SELECT *, round(({_SCORE}) / {sum(map(abs, L.SIGNAL_WEIGHTS.values()))}, 9) AS probability FROM f)
SELECT a.doc_id, {", ".join(f"{_R(k)} AS {k}" for k in FEATURES)}, {_R("coalesce(probability, 0.5)")} AS probability,
  CASE WHEN probability IS NULL THEN '{L.NO_VERDICT}' {" ".join(f"WHEN probability >= {x} THEN '{v}'" for x, v in L.SIGNAL_VERDICTS)} ELSE '{L.LAST_VERDICT}' END AS verdict,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {name} > {least} THEN '{flag}' END" for flag, name, least in L.SIGNAL_FLAGS)}], lambda v: v IS NOT NULL), ',') AS flags
FROM a LEFT JOIN p USING (doc_id)"""
