"""DuckDB SQL of the web categories and model features."""

from __future__ import annotations

from inkstone.functions import category_lists as L
from inkstone.functions.segment import WS
from inkstone.operators.lexical import phrase_pattern
from inkstone.operators.model_features import NAMES_31
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import BASE, trimmed


def _n(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({column}, {_re2(p)}))" for p in patterns) + ")"


def _in(column: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, {_q(p)})::INT" for p in phrases) + ")"


def _norm(x: str, low: float, high: float) -> str:
    return f"greatest(0, least(1, (({x}) - {low}) / {high - low}))"


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0 END)"


_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
_STOP = "[" + ", ".join(_q(w) for w in L.STOP_WORDS) + "]"
_BY_TOKENS = "CASE WHEN n < 50 THEN 0.3 WHEN n < 100 THEN 0.5 WHEN n < 200 THEN 0.7 WHEN n < 500 THEN 0.85 ELSE 0.95 END"
_BY_SENTENCES = "CASE WHEN s < 5 THEN 0.3 WHEN s < 10 THEN 0.5 WHEN s < 20 THEN 0.7 WHEN s < 50 THEN 0.85 ELSE 0.95 END"
_SINGLE = [w for w in L.OVERUSED_WORDS if "-" not in w]
_EVERY = [m for ms in L.MARKERS.values() for m in ms]
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_''-]+')), lambda w: NOT list_contains(" + _STOP + ", w))"


def _row(name: str, number: int, ok: str, p: str, c: str, table: str) -> str:
    return f"SELECT doc_id, {_q(name)} AS name, {number}::INTEGER AS category, {_R(f'CASE WHEN {ok} THEN {p} ELSE 0.5 END')} AS ai_probability, {_R(f'CASE WHEN {ok} THEN {c} ELSE 0 END')} AS confidence FROM {table}"


_DIALECT = {"us": L.AMERICAN_SPELLING, "uk": L.BRITISH_SPELLING, "us_words": L.AMERICAN_WORDS, "uk_words": L.BRITISH_WORDS, "modern": L.MODERN_SLANG + L.MODERN_PHRASES, "archaic": L.ARCHAIC_FORMAL}


def _has(words: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(low, {_re2(chr(92) + 'b' + w + chr(92) + 'b')})::INT" for w in words) + ")"


_SURE_4 = "CASE WHEN n < 50 THEN 0.2 WHEN n < 100 THEN 0.4 WHEN n < 200 THEN 0.6 WHEN n < 500 THEN 0.8 ELSE 0.9 END"
_P4 = f"""0.3 * {_norm("least(us, uk)", 0, 3)} + 0.2 * (CASE WHEN dq > 0 AND sq > 5 THEN 0.3 ELSE 0 END + CASE WHEN oxford > 0 AND no_oxford > 0 THEN 0.4 ELSE 0 END + CASE WHEN us_dates > 0 AND uk_dates > 0 THEN 0.3 ELSE 0 END)
  + 0.25 * {_norm("least(us_words, uk_words)", 0, 2)} + 0.25 * {_norm("least(modern, archaic)", 0, 2)}"""
_P7 = f"""0.25 * (1 - (0.5 * (1 - {_norm(_div("generic", "s"), 0, 0.3)}) + 0.5 * {_norm(_div("concrete", "s"), 0, 0.5)})) + 0.3 * (1 - {_norm("lived + 2 * told", 0, 8)})
  + 0.2 * (0.5 * {_norm("CASE WHEN hedged + firm > 0 THEN hedged / (hedged + firm) ELSE 0.5 END", 0.3, 0.7)} + 0.5 * {_norm("claims", 0, 3)})
  + 0.25 * (0.4 * {_norm("neutral", 0, 4)} + 0.3 * (1 - {_norm("strong", 0, 3)}) + CASE WHEN pro > 0 AND con > 0 AND abs(pro - con) <= 1 THEN 0.3 ELSE 0 END)"""
_CASE_KIND = f"""CASE WHEN sub AND co THEN 3 WHEN sub THEN 2 WHEN co THEN 1 ELSE 0 END AS kind FROM (SELECT doc_id, ({_in("lower(s)", [x for c in L.SUBORDINATORS for x in (f"{c} ", f", {c}")])}) > 0 AS sub,
  ({_in("lower(s)", [f" {c} " for c in L.COORDINATORS])}) > 0 AS co FROM sent)"""
WEB_CATEGORIES = rf"""
WITH {BASE},
t AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS v FROM tok GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS cv, count(*) FILTER (c = 1) AS c1 FROM (SELECT doc_id, w, count(*) AS c FROM tok WHERE length(w) > 2 AND NOT list_contains({_STOP}, w) GROUP BY ALL) GROUP BY doc_id),
st AS (SELECT doc_id, coalesce(sum(c) FILTER (c > 1), 0) AS again FROM (SELECT doc_id, lower(array_to_string(regexp_extract_all(s, '[^{WS}]+')[1:3], ' ')) AS k, count(*) AS c FROM sent GROUP BY ALL) GROUP BY doc_id),
sl AS (SELECT doc_id, count(*) AS s, avg(x) AS m, stddev_pop(x) AS sd, string_agg(q, ' ' ORDER BY no) AS flow FROM (SELECT doc_id, no, s AS q, len(regexp_extract_all(lower(s), '[a-z0-9_''-]+')) AS x FROM sent) GROUP BY doc_id),
ki AS (SELECT doc_id, -sum(c / k * log2(c / k)) AS h FROM (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS k FROM (SELECT doc_id, kind, count(*) AS c FROM (SELECT doc_id, {_CASE_KIND}) GROUP BY ALL)) GROUP BY doc_id),
pa AS (SELECT doc_id, list_filter(string_split_regex(text, '\n[{WS}]*\n'), lambda q: {trimmed("q")} <> '') AS ps FROM d),
pc AS (SELECT doc_id, len(ps) AS p, {_CONTENT.format("coalesce(ps[1], '')")} AS f, {_CONTENT.format("coalesce(ps[-1], '')")} AS l, list_transform(ps, lambda q: len(regexp_extract_all(lower(q), '[a-z0-9_''-]+'))::DOUBLE) AS k FROM pa),
j AS (
  SELECT d.doc_id, text, lower(text) AS low, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(cv, 0) AS cv, coalesce(c1, 0) AS c1, coalesce(s, 0) AS s, coalesce(m, 0) AS m, coalesce(sd, 0) AS sd, coalesce(flow, '') AS flow,
    coalesce(again, 0) AS again, coalesce(h, 0) AS h, p, len(list_intersect(f, l)) AS both_, least(len(f), len(l)) AS small, CASE WHEN p >= 2 THEN coalesce(list_stddev_pop(k) / nullif(list_avg(k), 0), 0) ELSE 0 END AS pcv
  FROM d LEFT JOIN t USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN sl USING (doc_id) LEFT JOIN ki USING (doc_id) LEFT JOIN pc USING (doc_id)),
x AS (
  SELECT *, {_n("text", L.GRAMMAR_ERRORS)} AS errors, {_n("text", ["(?i)" + phrase_pattern(p) for p in L.FORMAL_PHRASES])} AS formal, {_n("text", L.SELF_CORRECTIONS)} AS fixes,
    {_n("text", [rf"(?i)\b(?:{'|'.join(L.COORDINATORS)})\b"])} AS conj, {_in("low", L.TRANSITIONS)} AS trans,
    {_n("low", [rf"\b(?:{'|'.join(_SINGLE)})\b", *[rf"\b{w}\b" for w in L.OVERUSED_WORDS if "-" in w]])} AS over_, {_in("low", L.OVERUSED_PHRASES)} AS phrases, {_in("low", L.ACADEMIC_WORDS)} AS academic,
    ({" + ".join(f"regexp_matches(low, {_re2(chr(92) + 'b' + w + chr(92) + 'b')})::INT" for w in L.CONVERSATIONAL_WORDS)}) AS casual,
    ({" + ".join(f"(length(low) - length(replace(low, {_q(m)}, ''))) / {len(m)}" for m in _EVERY)}) AS inside,
    {_n("text", ["(?i)" + phrase_pattern(m).replace(chr(92) + "s+", " ") for m in _EVERY])} AS markers, {_n("flow", L.RESTATEMENTS)} AS rest, {_n("flow", L.DIGRESSIONS)} AS aside,
    CASE WHEN sd <> m THEN (sd - m) / (sd + m + 0.001) ELSE 0 END AS burst,
    {_in("low", L.GENERIC_PHRASES)} AS generic, {_n("text", L.CONCRETE)} AS concrete, ({" + ".join(f"regexp_matches(low, {_re2(chr(92) + 'b' + w + chr(92) + 'b')})::INT" for w in L.EXPERIENCE)}) AS lived,
    coalesce((SELECT count(*) FROM sent WHERE sent.doc_id = j.doc_id AND regexp_matches(s, {_re2(L.ANECDOTE)})), 0) AS told, {_n("text", [L.QUALIFIED])} AS hedged, {_n("text", [L.ASSERTIVE])} AS firm,
    ({" + ".join(f"(regexp_matches(text, {_q('(?i)' + c)}) AND NOT regexp_matches(substr(text, strpos(text, regexp_extract(text, {_q('(?i)' + c)})), 100), {_re2(L.CITED)}))::INT" for c in L.CLAIMS)}) AS claims,
    {_in("low", L.NONCOMMITTAL)} AS neutral, {_in("low", L.STRONG_STANCE)} AS strong, {_n("text", [L.FOR])} AS pro, {_n("text", [L.AGAINST])} AS con,
    {", ".join(f"{_has(ws)} AS {k}" for k, ws in _DIALECT.items())}, {_n("text", [chr(34)])} AS dq, {_n("text", [chr(39)])} AS sq,
    {", ".join(f"{_n('text', [p])} AS {k}" for k, p in (("oxford", L.OXFORD), ("no_oxford", L.NO_OXFORD), ("us_dates", L.US_DATES), ("uk_dates", L.UK_DATES)))}
  FROM j)
{_row("Grammar & Error Patterns", 1, "n > 0", f"0.3 * (1 - {_norm(_div('errors', 'n') + ' * 1000', 0, 10)}) + 0.25 * {_norm(_div('formal', 's'), 0, 0.3)} + 0.25 * (1 - {_norm('fixes', 0, 5)}) + 0.2 * {_norm(_div('again', 's'), 0, 0.5)}", _BY_TOKENS, "x")}
UNION ALL {_row("Sentence Structure & Syntax", 2, "s > 0", f"0.25 * (1 - {_norm(_div('sd', 'm'), 0.3, 0.8)}) + 0.25 * (1 - {_norm('burst + 1', 0, 1)}) + 0.25 * (1 - h / log2(greatest(4, s))) + 0.25 * (0.5 * {_norm(_div('conj', 's'), 0, 2)} + 0.5 * {_norm(_div('trans', 's'), 0, 0.3)})", _BY_SENTENCES, "x")}
UNION ALL {_row("Lexical Choice & Vocabulary", 3, "n >= 10", f"0.25 * (1 - {_norm(_div('v', 'n'), 0.25, 0.65)}) + 0.2 * (1 - {_norm(_div('c1', 'cv'), 0.2, 0.6)}) + 0.35 * least(1, {_norm(_div('over_', 'n'), 0, 0.05)} + least(0.3, phrases * 0.05)) + 0.2 * (CASE WHEN academic > 0 AND casual = 0 THEN 0.8 ELSE (1 - {_norm('casual', 0, 5)}) * 0.5 END)", _BY_TOKENS, "x")}
UNION ALL {_row("Dialect & Regional Consistency", 4, "n >= 20", _P4, _SURE_4, "x")}
UNION ALL {_row("Semantic & Pragmatic Features", 7, "n >= 30", _P7, _BY_TOKENS.replace("0.95", "0.9"), "x")}
UNION ALL {_row("Discourse & Coherence", 6, "s >= 5", f"0.25 * {_norm(_div('inside', 's'), 0, 0.3)} + 0.2 * (CASE WHEN p >= 2 THEN 1 - {_norm('pcv', 0.2, 0.6)} ELSE 0.5 END) + 0.3 * {_norm(_div('markers', 's'), 0, 0.4)} + 0.25 * (0.3 * {_norm('rest', 0, 3)} + 0.4 * {_norm(_div('both_', 'small'), 0.3, 0.7)} + 0.3 * (1 - {_norm('aside', 0, 3)}))", "CASE WHEN p < 2 OR s < 10 THEN 0.3 WHEN s < 20 THEN 0.5 WHEN s < 50 THEN 0.7 ELSE 0.9 END", "x")}"""

_COUNTS = L.MODEL_COUNTS | {"instruction_phrases": r"(?i)\b(?:first,|second,|finally,|step \d|for example)\b"}
_FEATURE = {k: _n("text", [p]) for k, p in _COUNTS.items()}
_FEATURE |= {k: f"{_FEATURE[k]} / n" for k in L.BY_WORD} | {k: f"{_FEATURE[k]} / s" for k in L.BY_SENTENCE}
_FEATURE |= {
    "answer_opener": rf"regexp_matches({trimmed('text')}, '(?i)^(?:Yes|No|Sure|Certainly|Of course|Absolutely)\b')::INT", "numbered_items": rf"len(regexp_extract_all(text, '(?m)^[{WS}]*\d+[.)][{WS}]+'))",
    "avg_sent_len": "coalesce(list_avg(k), 0)", "sent_len_std": "coalesce(list_stddev_pop(k), 0)", "sent_count": "s", "min_sent_len": "coalesce(list_min(k), 0)",
    "para_count": f"len(list_filter(string_split_regex(text, '\\n\\n'), lambda p: {trimmed('p')} <> ''))",
    "has_code": rf"regexp_matches(text, '```|def[{WS}]+[A-Za-z0-9_]+|function[{WS}]*\(')::INT", "has_html": "regexp_matches(text, '(?i)<[a-z]+[^>]*>')::INT",
    "word_count": "n", "vocab_richness": "len(list_distinct(list_transform(w, lambda q: lower(q)))) / n",
}
MODEL_FEATURES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, string_split_regex(text, '[{WS}]+') AS w, list_filter(string_split_regex(text, '[.!?]+'), lambda p: {trimmed("p")} <> '') AS ss FROM d),
y AS (SELECT *, len(w)::DOUBLE AS n, greatest(len(ss), 1)::DOUBLE AS s, list_transform(ss, lambda q: len(regexp_extract_all(q, '[^{WS}]+'))::DOUBLE) AS k FROM x)
SELECT doc_id, {", ".join(f"CASE WHEN length(text) >= 10 THEN {_R(_FEATURE[c])} END AS {c}" for c in NAMES_31)} FROM y"""


def _share(words: list[str]) -> str:
    return "len(list_filter(w, lambda q: q IN (" + ", ".join(_q(x) for x in words) + "))) / n"


TONE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (
  SELECT *, string_split_regex(lower(text), '[{WS}]+') AS w, greatest(len(list_filter(string_split_regex(text, '[.!?]+'), lambda p: {trimmed("p")} <> '')), 1) AS s,
    list_transform(list_filter(string_split_regex(text, '\n\n+'), lambda p: {trimmed("p")} <> ''), lambda p: len(string_split_regex(p, '[{WS}]+'))::DOUBLE) AS k FROM d),
y AS (SELECT *, len(w)::DOUBLE AS n FROM x),
g AS (
  SELECT doc_id, m, -sum(c / t * log2(c / t)) / nullif(log2(any_value(t)), 0) AS h FROM (
    SELECT doc_id, m, c, sum(c) OVER (PARTITION BY doc_id, m) AS t FROM (
      SELECT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS z, count(*) AS c FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM y, (SELECT unnest([2, 3]) AS m) WHERE len(w) >= m) GROUP BY ALL)) GROUP BY doc_id, m),
gg AS (SELECT doc_id, max(h) FILTER (m = 2) AS h2, max(h) FILTER (m = 3) AS h3 FROM g GROUP BY doc_id)
SELECT doc_id, {_R(f"greatest(0, least(1, 0.5 + 10 * {_share(L.FORMAL_MARKERS)} - 5 * {_share(L.CONTRACTIONS)}))")} AS formality, {_R(f"{_share(L.EMOTIONAL_WORDS)} + len(regexp_extract_all(text, '!')) * 0.5 / n")} AS emotion,
  {_R(_share(L.HEDGE_WORDS))} AS hedging, {_R(_share(L.FIRST_SINGULAR))} AS first_singular, {_R(_share(L.FIRST_PLURAL))} AS first_plural, {_R("len(regexp_extract_all(text, '[?]')) / s")} AS questions,
  {_R(rf"(len(regexp_extract_all(text, '(?i)\b(?:is|are|was|were|be|been|being)[{WS}]+\w+ed\b')) + len(regexp_extract_all(text, '(?i)\b(?:is|are|was|were|be|been|being)[{WS}]+\w+en\b'))) / s")} AS passives,
  {_R("CASE WHEN len(k) >= 2 THEN greatest(0, least(1, 1 - list_stddev_pop(k) / greatest(list_avg(k), 1))) ELSE 0.5 END")} AS even_paragraphs, {_R("coalesce(h2, 0)")} AS pair_entropy, {_R("coalesce(h3, 0)")} AS triple_entropy
FROM y LEFT JOIN gg USING (doc_id)"""
COMBINED = f"""
WITH c AS (SELECT *, confidence AS w, ln(greatest(0.001, least(0.999, ai_probability)) / (1 - greatest(0.001, least(0.999, ai_probability)))) AS o FROM ({WEB_CATEGORIES}) WHERE confidence > 0.2)
SELECT doc_id, count(*) AS n_categories, round(sum(w * ai_probability) / sum(w), 4) AS weighted, round(1 / (1 + exp(-sum(w * o) / sum(w))), 4) AS log_odds, round(1 - least(1, 2 * stddev_pop(ai_probability)), 4) AS agreement,
  count(*) FILTER (ai_probability > 0.65) AS n_ai, count(*) FILTER (ai_probability < 0.35) AS n_human, count(*) FILTER (ai_probability > 0.65) >= 2 AND count(*) FILTER (ai_probability < 0.35) >= 2 AS contradictory, round(avg(confidence), 4) AS mean_confidence
FROM c GROUP BY doc_id"""
