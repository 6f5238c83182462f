"""DuckDB SQL of the voice categories, the heads and the relative scores."""

from __future__ import annotations

import math

from inkstone.functions import voice_lists as L
from inkstone.functions.segment import WS
from inkstone.operators.voice_categories import DIMENSIONS
from inkstone.plans.category_sql import WEB_CATEGORIES, _div, _in, _n, _norm, _row
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import BASE, trimmed
from inkstone.plans.style_sql import _INNER, _listed

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_''-]+')"
_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"


def _half(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) ELSE 0.5 END"


def _even(x: str, least: int = 2) -> str:
    level = f"round(avg({x}), 12)"
    return f"CASE WHEN count(*) < {least} THEN 0.5 ELSE 1 - least(1, {_div(f'stddev_pop({x})', level)} / 0.8) END"


_SHIFT = [("register", 0.3), ("emotion", 0.1), ("modality", 0.3)]
_HELPER = f"{_n('text', L.HELPER_PATTERNS)} + {_in('lower(text)', L.HELPER_PHRASES)} + {_in('substr(lower(text), 1, 100)', L.HELPER_OPENINGS)}"
TONE = rf"""
WITH {BASE},
c AS (SELECT doc_id, no, len(ws) AS n, {", ".join(f"{_listed(words)} AS {k}" for k, words in L.VOICE.items())} FROM (SELECT doc_id, no, {_WORDS.format("s")} AS ws FROM sent)),
t AS (
  SELECT doc_id, no, {_half("formal", "informal")} AS register, {_div("positive - negative", "n")} AS emotion, {_half("certainty", "c.hedging")} AS modality, {_div("c.hedging", "n")} AS hedging,
    (first + second) / (first + second + third + 1) AS pronouns FROM c),
g AS (SELECT *, {", ".join(f"abs({k} - lag({k}) OVER (PARTITION BY doc_id ORDER BY no)) AS d_{k}" for k, _ in _SHIFT)} FROM t),
u AS (
  SELECT doc_id, count(*) AS s, round(({" + ".join(f"({_even(k, 3)})" for k in DIMENSIONS)}) / 5, 9) AS steady, {_even("register", 3)} AS register, CASE WHEN max(hedging) = 0 THEN 1 ELSE {_even("hedging")} END AS hedged,
    1 - least(1, stddev_pop(emotion) * 10) AS flat, {" + ".join(f"count(*) FILTER (d_{k} > {x})" for k, x in _SHIFT)} AS shifts, {" + ".join(f"count(*) FILTER (d_{k} > 0.4)" for k, _ in _SHIFT)} AS sudden
  FROM g GROUP BY doc_id),
x AS (
  SELECT d.doc_id, length(text) AS len_, coalesce(s, 0) AS s, coalesce(steady, 0.5) AS steady, coalesce(register, 0.5) AS register, coalesce(hedged, 1) AS hedged, coalesce(flat, 1) AS flat, coalesce(shifts, 0) AS shifts,
    coalesce(sudden, 0) AS sudden, {_norm(_HELPER, 0, 6)} AS helper
  FROM d LEFT JOIN u USING (doc_id))
{_row("Tone Stability", 13, "len_ >= 100", "greatest(0, least(1, 0.2 * steady + 0.15 * hedged + 0.2 * flat + 0.1 * register + 0.2 * helper + CASE WHEN steady > 0.85 THEN 0.1 ELSE 0 END + CASE WHEN shifts = 0 AND steady > 0.7 THEN 0.05 ELSE 0 END + CASE WHEN helper > 0.5 THEN 0.1 ELSE 0 END - CASE WHEN sudden > 0 THEN 0.1 ELSE 0 END))", "CASE WHEN s < 5 THEN 0.2 WHEN s < 10 THEN 0.4 WHEN s < 20 THEN 0.6 WHEN s < 50 THEN 0.75 ELSE 0.85 END", "x")}"""

_PLACE = "list_transform(list_transform(qs, lambda q: regexp_replace(lower(q), '[^a-z]', '', 'g')), lambda q, i: CASE WHEN i > 1 AND q LIKE '%ly' AND length(q) > 4 THEN CASE WHEN i - 1 < k / 3 THEN 1 WHEN i - 1 >= k - 2 THEN 3 ELSE 2 END END)"
_AT = lambda i: f"CASE WHEN k >= 3 THEN len(list_filter(pl, lambda v: v = {i})) ELSE 0 END AS a{i}"
_P14 = """greatest(0, least(1, 0.5 + CASE WHEN stock / greatest(adverbs, 1) > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN phrases > 3 THEN least(0.2, 0.03 * phrases) ELSE 0 END
  + CASE WHEN (CASE WHEN t0 + t1 + t2 > 0 THEN greatest(t0, t1, t2) / (t0 + t1 + t2) ELSE 0.5 END) > 0.9 THEN 0.1 ELSE 0 END
  + CASE WHEN (CASE WHEN a0 + a1 + a2 + a3 > 0 THEN (a0 + a1) / (a0 + a1 + a2 + a3) ELSE 0.5 END) > 0.6 THEN 0.1 ELSE 0 END
  - CASE WHEN personal > 2 THEN 0.15 ELSE 0 END + CASE WHEN hedging / greatest(verbs, 1) > 0.3 THEN 0.1 ELSE 0 END))"""
_SURE_14 = "0.4 + " + " + ".join(f"CASE WHEN len_ > {k} THEN 0.1 ELSE 0 END" for k in (500, 1000, 2000)) + " + " + " + ".join(f"CASE WHEN adverbs > {k} THEN 0.1 ELSE 0 END" for k in (5, 10))
WORD_CLASSES = rf"""
WITH {BASE},
w AS (SELECT doc_id, s, string_split_regex(s, '[{WS}]+') AS qs FROM sent),
k AS (SELECT *, len(qs) AS k FROM w),
pl AS (SELECT *, {_PLACE} AS pl, {", ".join(f"len(regexp_extract_all(s, {_re2(p)})) AS {t}_" for t, p in L.TENSES.items())} FROM k),
o AS (
  SELECT doc_id, CASE WHEN k >= 3 THEN (regexp_replace(lower(qs[1]), '[^a-z]', '', 'g') IN ({", ".join(map(_q, L.STOCK_ADVERBS))}))::INT ELSE 0 END AS a0, {", ".join(map(_AT, (1, 2, 3)))},
    CASE WHEN past_ > present_ AND past_ > future_ THEN 0 WHEN present_ > past_ AND present_ > future_ THEN 1 WHEN future_ > 0 THEN 2 ELSE 3 END AS tense FROM pl),
g AS (SELECT doc_id, sum(a0) AS a0, sum(a1) AS a1, sum(a2) AS a2, sum(a3) AS a3, count(*) FILTER (tense = 0) AS t0, count(*) FILTER (tense = 1) AS t1, count(*) FILTER (tense = 2) AS t2 FROM o GROUP BY doc_id),
x AS (
  SELECT d.doc_id, length(text) AS len_, {", ".join(f"coalesce({c}, 0) AS {c}" for c in "a0 a1 a2 a3 t0 t1 t2".split())}, {_n("text", [L.ADVERB])} AS adverbs, {_n("text", [rf"(?i)\b{a}\b" for a in L.STOCK_ADVERBS])} AS stock,
    {_n("text", [rf"(?i)\b{a}\b" for a in L.HEDGING_VERBS])} AS hedging, {_n("text", [L.VERB])} AS verbs, {_n("text", ["(?i)" + p for p in L.PERSONAL_PATTERNS])} AS personal,
    {_n("text", ["(?i)" + p.replace(" ", chr(92) + "s+") for p in L.VERB_PHRASES])} AS phrases
  FROM d LEFT JOIN g USING (doc_id))
{_row("Part of Speech Patterns", 14, "len_ >= 50", _P14, _SURE_14, "x")}"""

_GRAM = "list_aggregate(ws[i:i + n - 1], 'string_agg', ' ')"
_JACCARD = "len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)"
_LENGTHS = "list_transform(" + _INNER + f", lambda q: len(string_split_regex(q, '[{WS}]+')))"
REPETITION = rf"""
WITH {BASE},
dw AS (SELECT doc_id, text, {_WORDS.format("text")} AS ws FROM d),
gr AS (SELECT doc_id, n, i, {_GRAM} AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, (VALUES (2), (3), (4), (5)) v(n))),
ga AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, n, g ORDER BY i) AS gap FROM gr),
gs AS (SELECT doc_id, count(*) AS n_gaps, CASE WHEN count(*) < 2 THEN 0.5 ELSE 1 - least(1, coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) / 0.8) END AS even_, coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) AS cv FROM ga WHERE gap IS NOT NULL AND n <= 4 GROUP BY doc_id),
tp AS (
  SELECT doc_id, count(*) AS tops, round(1 - least(1, coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) / 0.8), 9) AS top_even
  FROM (SELECT doc_id, n, g, avg(gap) AS gap FROM ga WHERE n >= 3 GROUP BY doc_id, n, g HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, n, min(i)) <= 10) GROUP BY doc_id),
sw AS (SELECT doc_id, no, list_distinct({_WORDS.format("s")}) AS w FROM sent),
ne AS (SELECT a.doc_id, count(*) AS near FROM sw a JOIN sw b ON a.doc_id = b.doc_id AND b.no BETWEEN a.no + 1 AND a.no + 4 WHERE {_JACCARD} > 0.4 GROUP BY a.doc_id),
ps AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, '
[{WS}]*
'), lambda q: {trimmed("q")} <> '') AS ps FROM d)),
pw AS (SELECT doc_id, i, list_distinct({_WORDS.format("p")}) AS w, array_to_string(list_transform({_LENGTHS}, lambda k: CASE WHEN k < 10 THEN 'S' WHEN k < 20 THEN 'M' ELSE 'L' END), '') AS shape FROM ps),
al AS (SELECT a.doc_id, count(*) AS alike FROM pw a JOIN pw b ON a.doc_id = b.doc_id AND b.i > a.i WHERE {_JACCARD} > 0.3 GROUP BY a.doc_id),
pc AS (SELECT doc_id, count(*) AS p, count(DISTINCT shape) AS shapes FROM pw GROUP BY doc_id),
sc AS (SELECT doc_id, count(*) AS s FROM sent GROUP BY doc_id),
x AS (
  SELECT dw.doc_id, length(text) AS len_, len(ws) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(near, 0) AS near, coalesce(alike, 0) AS alike, coalesce(shapes, 0) AS shapes, coalesce(tops, 0) AS tops, coalesce(top_even, 0) AS top_even,
    CASE WHEN n_gaps > 2 THEN even_ ELSE 0.5 END AS even_, CASE WHEN n_gaps > 2 THEN least(1, cv) ELSE 0.5 END AS clustered
  FROM dw LEFT JOIN gs USING (doc_id) LEFT JOIN tp USING (doc_id) LEFT JOIN ne USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN pc USING (doc_id) LEFT JOIN sc USING (doc_id))
{_row("Repetition Patterns", 12, "len_ >= 100", f"greatest(0, least(1, 0.3 * even_ + 0.25 * (1 - clustered) + 0.25 * least(1, 2 * (0.6 * {_div('near', 's')} + 0.4 * (CASE WHEN p > 1 THEN alike / (p - 1) ELSE 0 END))) + 0.2 * (CASE WHEN p > 1 THEN 1 - shapes / p ELSE 0.5 END) + CASE WHEN tops > 5 AND top_even > 0.7 THEN 0.1 ELSE 0 END))", "0.3 + CASE WHEN n > 500 THEN 0.3 WHEN n > 200 THEN 0.2 WHEN n > 100 THEN 0.1 ELSE 0 END + CASE WHEN s > 20 THEN 0.2 WHEN s > 10 THEN 0.1 ELSE 0 END", "x")}"""

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(s, {_re2(p)}) THEN {i}" for i, p in enumerate(L.OPENING_KINDS)) + f" ELSE {len(L.OPENING_KINDS)} END"
_LETTERS = "coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)"
_STYLE = {
    "y0": "n / k", "y1": _div(_LETTERS, "n"), "y2": f"{_n('t', [L.PASSIVE])} / k", "y3": "questions / k", "y4": "calls / k", "y5": _div(_n("t", [L.FIRST_PERSON]), "n"),
}
_SLIPS = {f"e{i}": _n("t", [p]) for i, p in enumerate(L.SLIPS)}
INCONSISTENCY = rf"""
WITH {BASE},
o AS (SELECT doc_id, no, s, {_KIND} AS kind, (no - 1) // greatest(3, count(*) OVER (PARTITION BY doc_id) // 4) AS seg, len({_WORDS.format("s")}) AS k FROM sent),
r AS (SELECT *, (kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY no))::INT AS again FROM o),
op AS (SELECT doc_id, count(*) AS s, coalesce(sum(again), 0) AS again FROM r GROUP BY doc_id),
en AS (SELECT doc_id, -sum(c / t * log2(c / t)) AS h FROM (SELECT doc_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM o GROUP BY doc_id, kind) GROUP BY doc_id),
sg AS (
  SELECT doc_id, seg, string_agg(s, ' ' ORDER BY no) AS t, count(*)::DOUBLE AS k, count(*) FILTER (s LIKE '%?') AS questions, count(*) FILTER (s LIKE '%!') AS calls,
    list_distinct(list(CASE WHEN k < 3 THEN 0 WHEN k < 8 THEN 1 WHEN k < 15 THEN 2 WHEN k < 25 THEN 3 ELSE 4 END)) AS kinds
  FROM o GROUP BY doc_id, seg),
sw AS (SELECT *, {_WORDS.format("t")} AS ws, {_n("t", [L.SUBORDINATE])} + 2 * {_n("t", [L.CONNECTIVE])} AS deep FROM sg),
sn AS (SELECT *, len(ws)::DOUBLE AS n, deep / k AS depth FROM sw),
m AS (
  SELECT doc_id, seg, kinds, list_distinct(ws) AS own, {_in("lower(t)", L.IDIOMS)} AS idioms, depth, ({_div(_LETTERS, "n")} / 10 + {_div("len(list_filter(ws, lambda w: length(w) > 8))", "n")}) / 2 AS lexical,
    {", ".join(f"{x} AS {c}" for c, x in (_STYLE | _SLIPS).items())} FROM sn),
z AS (SELECT *, CASE WHEN depth = 0 THEN lexical * 10 ELSE lexical / (depth + 0.1) END AS balance, {" + ".join(f"abs({c} - lag({c}) OVER (PARTITION BY doc_id ORDER BY seg))" for c in _STYLE)} AS change FROM m),
a AS (
  SELECT doc_id, var_pop(idioms) AS idioms, var_pop(balance) AS balance, avg(change) AS drift, sum({" + ".join(_SLIPS)}) AS slips, ({" + ".join(f"var_pop({c})" for c in _SLIPS)}) / {len(_SLIPS)} AS slips_var,
    arg_min(own, seg) AS own1, arg_max(own, seg) AS own2, arg_min(kinds, seg) AS kinds1, arg_max(kinds, seg) AS kinds2 FROM z GROUP BY doc_id),
x AS (
  SELECT d.doc_id, length(text) AS len_, coalesce(s, 0) AS s, (1 - h / {math.log2(len(L.OPENING_KINDS) + 1)}) * 0.6 + again / s * 0.4 AS alike, idioms, balance, drift, slips, slips_var,
    ({_div("len(list_intersect(own1, own2))", "greatest(len(own1), len(own2))")} + {_div("len(list_intersect(kinds1, kinds2))", "greatest(len(kinds1), len(kinds2))")}) / 2 AS same
  FROM d LEFT JOIN op USING (doc_id) LEFT JOIN en USING (doc_id) LEFT JOIN a USING (doc_id))
{_row("Intra-document Inconsistency", 16, "len_ >= 300 AND s >= 8", f"0.15 * (1 - alike) + 0.15 * {_norm('idioms', 0, 3)} + 0.2 * {_norm('balance', 0, 2)} + 0.15 * (1 - CASE WHEN slips = 0 THEN 0.2 ELSE {_norm('slips_var', 0, 2)} END) + 0.2 * (1 - {_norm('drift', 0, 3)}) + 0.15 * (1 - same)", "CASE WHEN s < 10 THEN 0.3 WHEN s < 20 THEN 0.6 WHEN s < 40 THEN 0.75 ELSE 0.85 END", "x")}"""

UNDECIDED = f"WITH x AS (SELECT doc_id, length(coalesce(text, '')) AS len_ FROM documents) {_row('Multi-Head Ensemble', 17, 'len_ >= 100', '0.5', '0.6', 'x')}"

_CASE_HEAD = "CASE " + " ".join(f"WHEN category IN ({', '.join(map(str, numbers))}) THEN '{k}'" for k, (numbers, _) in L.HEADS.items()) + " END"
_NAMES = list(L.HEADS)
_AGAINST = [f"CASE WHEN abs({a} - {b}) > 0.4 AND least({a}, {b}) < 0.4 AND greatest({a}, {b}) > 0.6 THEN abs({a} - {b}) END" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]
_WEIGHTED = " + ".join(f"{k} * {w}" for k, (_, w) in L.HEADS.items())
HEADS = f"""
WITH c AS (SELECT *, {_CASE_HEAD} AS head FROM (SELECT * FROM ({WEB_CATEGORIES}) UNION ALL SELECT * FROM ({TONE}) UNION ALL SELECT * FROM ({INCONSISTENCY}))),
g AS (SELECT doc_id, {", ".join(f"coalesce(sum(ai_probability * confidence) FILTER (confidence > 0.1 AND head = '{k}') / sum(confidence) FILTER (confidence > 0.1 AND head = '{k}'), 0.5) AS {k}" for k in _NAMES)} FROM c GROUP BY doc_id),
x AS (SELECT *, [{", ".join(_NAMES)}] AS every, list_filter([{", ".join(_AGAINST)}], lambda v: v IS NOT NULL) AS against FROM g),
y AS (SELECT *, 1 - least(1, 2 * list_stddev_pop(every)) AS agreement, len(list_filter(every, lambda v: v > 0.7 OR v < 0.3)) / {len(_NAMES)} AS strong FROM x)
SELECT doc_id, {", ".join(f"{_R(k)} AS {k}" for k in _NAMES)}, {_R(f"({_WEIGHTED}) / {sum(w for _, w in L.HEADS.values())}")} AS ai_probability, {_R("agreement")} AS agreement,
  {_R("greatest(0, least(1, agreement * 0.6 + strong * 0.4))")} AS confidence, len(against)::INTEGER AS n_conflicts, {_R("coalesce(list_avg(against), 0)")} AS conflict
FROM y"""

_FOUND = lambda p, one: _n("text", [p]) if one == 0 else f"{one} * regexp_matches(text, {_re2(p)})::INT"
_MEASURE = {
    "richness": f"least({_div('v', 'sqrt(n)')} / 5, 1)", "complexity": f"{_norm('n / greatest(s, 1)', 5, 35)} * 0.6 + {_norm(_div('subordinate', 's'), 0, 0.5)} * 0.4",
    "formality": f"{_norm(_div('2 * formal - informal - short', 'n') + ' * 100 + 50', 0, 100)} / 100", "passive": "least(passives / greatest(s, 1), 1)", "first_person": "least(mine / greatest(n, 1), 1)",
    "repetition": "often / greatest(v, 1)", "burstiness": f"CASE WHEN s > 1 THEN {_norm('var_k', 0, 100)} ELSE 0.5 END",
}
_ROWS = ", ".join(f"('{k}', {t}, " + ", ".join(f"{m}, {sd}" for m, sd in ranges) + ")" for k, (ranges, t) in L.COHORT_RANGES.items())
_COLUMNS = ", ".join(f"m_{k}, sd_{k}" for k in L.MEASURES)
RELATIVE = rf"""
WITH {BASE},
b(cohort, limit_, {_COLUMNS}) AS (VALUES {_ROWS}),
v AS (SELECT doc_id, sum(c)::DOUBLE AS n, count(*) AS v, count(*) FILTER (c > 2) AS often FROM (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY ALL) GROUP BY doc_id),
k AS (SELECT doc_id, count(*)::DOUBLE AS s, var_pop(len({_WORDS.format("s")})) AS var_k FROM sent GROUP BY doc_id),
c AS (SELECT doc_id, length(text) AS len_, {", ".join(f"{_n('text', [p])} AS {name}" for name, p in L.COHORT_COUNTS.items())}, {", ".join("(" + " + ".join(_FOUND(p, one) for p, one in patterns) + f") AS c_{name}" for name, patterns in L.COHORTS.items())} FROM d),
e AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(often, 0) AS often, coalesce(s, 0) AS s, coalesce(var_k, 0) AS var_k, greatest({", ".join(f"c_{k}" for k in L.COHORTS)}) AS best FROM c LEFT JOIN v USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT doc_id, len_, best, CASE WHEN best < 3 THEN 'general' {" ".join(f"WHEN c_{k} = best THEN '{k}'" for k in L.COHORTS)} END AS cohort, {", ".join(f"{x} AS {m}" for m, x in _MEASURE.items())} FROM e),
z AS (SELECT doc_id, len_, best, cohort, limit_, {", ".join(f"({m} - m_{m}) / sd_{m} AS z_{m}" for m in L.MEASURES)} FROM f JOIN b USING (cohort)),
y AS (SELECT *, list_transform([{", ".join(f"z_{m}" for m in L.MEASURES)}], lambda q: abs(q)) AS off_, least(best / 10, 1) AS sure FROM z),
w AS (SELECT *, list_avg(off_) AS far, len(list_filter(off_, lambda q: q > limit_)) AS outliers, len(list_filter(off_, lambda q: q > limit_ * 1.5)) AS extreme, len_ >= 100 AS ok FROM y)
SELECT doc_id, CASE WHEN ok THEN cohort ELSE 'general' END AS cohort, {_R("CASE WHEN ok THEN sure ELSE 0 END")} AS cohort_confidence,
  {_R("CASE WHEN ok THEN least(0.15 * (outliers + extreme) + CASE WHEN far < 0.3 THEN 0.2 ELSE 0 END, 1) ELSE 0.5 END")} AS relative_score,
  {_R(f"CASE WHEN ok THEN least(0.5 * sure + 0.5 * {_norm('len_', 100, 2000)}, 1) ELSE 0 END")} AS confidence, (CASE WHEN ok THEN outliers ELSE 0 END)::INTEGER AS n_outliers,
  {_R("CASE WHEN ok THEN far END")} AS mean_abs_z, {", ".join(f"{_R(f'CASE WHEN ok THEN z_{m} END')} AS z_{m}" for m in L.MEASURES)}
FROM w"""

#: By the name of the query.
VOICE = {"tone_stability": TONE, "word_classes": WORD_CLASSES, "repetition_patterns": REPETITION, "inconsistency": INCONSISTENCY, "undecided_ensemble": UNDECIDED}
