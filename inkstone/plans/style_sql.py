"""DuckDB SQL of the style categories that have some."""

from __future__ import annotations

from inkstone.functions import style_lists as L
from inkstone.functions.segment import WS
from inkstone.plans.category_sql import _div, _in, _n, _norm, _row
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import BASE, _masked, _restored, trimmed


def _listed(words: list[str], column: str = "ws") -> str:
    return f"len(list_filter({column}, lambda w: w IN ({', '.join(map(_q, words))})))"


_CONTRACTIONS = _q(r"\b(?:" + "|".join(w.replace("'", "'?", 1) for w in L.STANDARD_CONTRACTIONS + L.INFORMAL_CONTRACTIONS) + r")\b")
_INFORMAL = _q(r"\b(?:" + "|".join(L.INFORMAL_CONTRACTIONS) + r")\b")
_HUMAN = "(loose + fillers)"
_P14 = f"""0.2 * (CASE WHEN short > 0.3 * s AND cv < 0.5 THEN least(1, (1 - cv) * 0.7 + CASE WHEN informal > 2 THEN 0.3 ELSE 0 END) ELSE 0 END)
  + 0.15 * (CASE WHEN {_div("fillers", "s")} > 0.15 THEN {_norm(_div("fillers", "s"), 0.15, 0.5)} ELSE 0 END)
  + 0.2 * (CASE typos WHEN 0 THEN 0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 0.9 END)
  + 0.15 * (CASE WHEN formal >= 2 AND slang >= 2 THEN {_norm("formal * slang", 0, 20)} ELSE 0 END)
  + 0.2 * (CASE WHEN left_ >= 1 AND {_HUMAN} >= 3 THEN {_norm(f"left_ * {_HUMAN}", 0, 15)} ELSE 0 END)
  + 0.1 * (CASE WHEN asked >= 2 THEN {_norm("asked", 2, 5)} ELSE 0 END)"""
REWRITING = rf"""
WITH {BASE},
k AS (
  SELECT doc_id, count(*)::DOUBLE AS s, coalesce(stddev_pop(c) / nullif(avg(c), 0), 0) AS cv, sum(f) AS fillers
  FROM (SELECT doc_id, len(regexp_extract_all(lower(s), {_CONTRACTIONS})) AS c, ({" OR ".join(f"starts_with({trimmed('lower(s)')}, {_q(f)})" for f in L.SENTENCE_FILLERS)})::INT AS f FROM sent)
  GROUP BY doc_id),
j AS (SELECT d.doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_''-]+') AS ws, coalesce(s, 0) AS s, coalesce(cv, 0) AS cv, coalesce(fillers, 0) AS fillers FROM d LEFT JOIN k USING (doc_id)),
x AS (
  SELECT *, len(ws)::DOUBLE AS n, len(regexp_extract_all(low, {_CONTRACTIONS})) AS short, len(regexp_extract_all(low, {_INFORMAL})) AS informal, {_listed(L.PLANTED_TYPOS)} AS typos,
    {_listed(L.FORMAL)} AS formal, {_listed(L.SLANG)} AS slang, {_listed(L.INFORMAL_CONTRACTIONS + L.SLANG)} AS loose, {_in("low", L.LEFTOVER_PHRASES)} AS left_, {_in("low", L.RHETORICAL_QUESTIONS)} AS asked
  FROM j)
{_row("Humanization Artifacts", 14, "n >= 20", _P14, f"({_norm('n', 50, 500)} + {_norm('s', 5, 30)}) / 2", "x")}"""

_OLD = L.ARCHAIC_VERBS + L.ARCHAIC_PRONOUNS + L.ARCHAIC_SYNTAX
_TRIED = f"({_div('old_', 'n')} > 0.01 OR old_ >= 3)"
_DEPTH = f"(0.4 * {_div('old_sentences', 's')} + CASE WHEN thou_forms > 0 AND you > 0 THEN 0 ELSE 0.3 END + CASE WHEN old_ends > 0 AND modern > old_ends THEN 0 ELSE 0.3 END)"
_THIRD = "(third_modern > 0 OR third_old > 0)"
_AGREE = f"(CASE WHEN pairs + {_THIRD}::INT > 0 THEN (agree + ({_THIRD} AND (third_modern = 0 OR third_old = 0))::INT) / (pairs + {_THIRD}::INT) ELSE 0.5 END)"
_P5 = f"(CASE WHEN {_TRIED} THEN 0.4 * (1 - {_DEPTH}) + 0.3 * {_norm('late', 0, 3)} + 0.3 * (1 - {_AGREE}) ELSE 0.5 END)"
_SURE_5 = f"(CASE WHEN {_TRIED} THEN CASE WHEN n < 100 THEN 0.3 WHEN n < 300 THEN 0.5 ELSE 0.7 END + CASE WHEN round(100 * {_div('old_', 'n')}, 2) > 2 THEN 0.2 ELSE 0 END ELSE 0.3 END)"
ARCHAIC = rf"""
WITH {BASE},
k AS (SELECT doc_id, count(*) AS s, count(*) FILTER ({_listed(_OLD, "regexp_extract_all(lower(s), '[a-z0-9_]+')")} > 0) AS old_sentences FROM sent GROUP BY doc_id),
j AS (
  SELECT d.doc_id, text, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws, len(regexp_extract_all(lower(text), '[a-z0-9_''-]+'))::DOUBLE AS n, coalesce(s, 0) AS s, coalesce(old_sentences, 0) AS old_sentences,
    regexp_extract_all(lower(text), '\bthou[{WS}]+([A-Za-z0-9_]+)', 1) AS thou
  FROM d LEFT JOIN k USING (doc_id)),
x AS (
  SELECT *, {_listed(_OLD, "list_distinct(ws)")} AS old_, {_listed(["thou", "thee", "thy"])} AS thou_forms, {_listed(["you"])} AS you, {_n("text", [r"(?i)[A-Za-z0-9_]+eth\b", r"(?i)[A-Za-z0-9_]+est\b"])} AS old_ends,
    {_listed(["does", "has", "is", "was", "goes"])} AS modern, {_listed(L.ANACHRONISMS, "list_distinct(ws)")} + {_in("low", L.MODERN_CONTRACTIONS)} AS late, len(thou) AS pairs,
    len(list_filter(thou, lambda v: v LIKE '%st' OR v IN ({", ".join(map(_q, L.THOU_FORMS))}))) AS agree,
    {_n("text", [r"(?i)\b(?:he|she|it)\s+(?:does|has|is|goes|says)\b"])} AS third_modern, {_n("text", [r"(?i)\b(?:he|she|it)\s+[A-Za-z0-9_]+th\b"])} AS third_old
  FROM j)
{_row("Archaic / Historical Grammar", 5, "n >= 20", _P5, _SURE_5, "x")}"""

_BALANCED = "(pro + con > 2 AND abs(pro - con) <= 1)"
_SHARE = "CASE WHEN p = 0 THEN 0.5 ELSE least(1, even_ / (0.5 * p)) END"
_ARC = f"(CASE WHEN p < 3 THEN 0.5 ELSE 0.5 * {_norm('intro + outro + (body >= 3)::INT', 0, 4)} + CASE WHEN p BETWEEN 4 AND 6 AND intro > 0 AND outro > 0 THEN 0.3 ELSE 0 END + 0.2 * {_norm('body', 0, 5)} END)"
_P10 = f"""0.2 * (0.5 * {_norm("templates", 0, 3)} + CASE WHEN {_BALANCED} THEN 0.5 ELSE 0 END)
  + 0.2 * (0.5 * {_norm(_div("cautious", "s"), 0, 0.2)} + 0.5 * {_norm("CASE WHEN cautious + firm > 0 THEN cautious / (cautious + firm) ELSE 0.5 END", 0.5, 0.9)})
  + 0.15 * (0.3 * (1 - {_norm("CASE WHEN p > 1 THEN cv ELSE 0.5 END", 0.2, 0.6)}) + 0.3 * (1 - {_norm("CASE WHEN p > 1 THEN sizes_cv ELSE 0.5 END", 0.3, 0.7)}) + 0.4 * ({_SHARE}))
  + 0.25 * {_ARC} + 0.2 * {_norm("assistant + openings", 0, 5)}"""


def _matched(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"coalesce(regexp_matches({column}, {_re2(p)}), false)::INT" for p in patterns) + ")"


def _cv(column: str) -> str:
    return f"coalesce(list_stddev_pop({column}) / nullif(list_avg({column}), 0), 0)"


_INNER = rf"list_filter(list_transform(string_split(regexp_replace({_masked('p')}, '([.!?])[{WS}]+([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda q: {trimmed(_restored('q'))}), lambda q: q <> '')"
SET_PIECES = rf"""
WITH {BASE},
k AS (SELECT doc_id, count(*)::DOUBLE AS s FROM sent GROUP BY doc_id),
pa AS (SELECT doc_id, text, lower(text) AS low, list_filter(string_split_regex(text, '
[{WS}]*
'), lambda q: {trimmed("q")} <> '') AS ps FROM d),
j AS (
  SELECT pa.*, coalesce(s, 0) AS s, len(ps) AS p, lower(ps[1]) AS first_, lower(ps[-1]) AS last_, list_transform(ps, lambda p: len(regexp_extract_all(lower(p), '[a-z0-9_''-]+'))::DOUBLE) AS words,
    list_transform(ps, lambda p: list_transform({_INNER}, lambda q: len(regexp_extract_all(lower(q), '[a-z0-9_''-]+'))::DOUBLE)) AS inside
  FROM pa LEFT JOIN k USING (doc_id)),
i AS (SELECT *, list_transform(inside, lambda a: len(a)::DOUBLE) AS sizes FROM j),
x AS (
  SELECT *, {_cv("words")} AS cv, {_cv("sizes")} AS sizes_cv, len(list_filter(inside, lambda a: len(a) >= 3 AND coalesce(list_stddev_pop(a) / nullif(list_avg(a), 0), 1) < 0.3)) AS even_,
    {_n("text", L.ASSISTANT_PATTERNS)} AS assistant, ({" + ".join(f"(starts_with(low, {_q(o)}) OR contains(low, chr(10) || {_q(o)}))::INT" for o in L.ASSISTANT_OPENINGS)}) AS openings,
    {_matched("text", L.BALANCE_TEMPLATES)} AS templates, {_n("low", [rf"\b{w}\b" for w in L.PRO_WORDS])} AS pro, {_n("low", [rf"\b{w}\b" for w in L.CON_WORDS])} AS con,
    {_in("low", L.CAUTIOUS_PHRASES)} AS cautious, {_in("low", L.STANCE_PHRASES)} AS firm, {_matched("first_", L.INTRODUCTIONS)} AS intro, {_matched("last_", L.CONCLUSIONS)} AS outro, {_n("text", L.BODY_SIGNS)} AS body
  FROM i)
{_row("Meta-Patterns Unique to AI", 10, "s >= 5", _P10, "(CASE WHEN p < 3 OR s < 10 THEN 0.4 WHEN s < 25 THEN 0.6 WHEN s < 50 THEN 0.8 ELSE 0.9 END)", "x")}"""

#: By the name of the query.
STYLE = {"rewriting_traces": REWRITING, "archaic_style": ARCHAIC, "set_pieces": SET_PIECES}
