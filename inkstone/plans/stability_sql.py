"""DuckDB SQL of the stability of texts under rewriting."""

from __future__ import annotations

from inkstone.functions import voice_lists as L
from inkstone.functions.segment import WS
from inkstone.plans.category_sql import _norm, _row
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import BASE

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_''-]+')"
_UP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"


def _tags(x: str) -> str:
    for words, tag in L.WORD_TAGS:
        x = f"regexp_replace({x}, {_q(rf'(?i)' + chr(92) + f'b(?:{words})' + chr(92) + 'b')}, '{tag}', 'g')"
    return f"string_split_regex({x}, '[{WS}]+')"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _part(p: str, k: int) -> str:
    return f"regexp_extract(s, {_re2(p)}, {k})"


def _fits(p: str) -> str:
    return f"regexp_matches(s, {_re2(p)})"


_FIRST = f"string_split_regex(s, '(?i)\\b' || w || '\\b')[1]"
_MATCH = f"substr(s, length({_FIRST}) + 1, 1)"
_OTHER = "CASE w " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in L.SYNONYM.items()) + " END"
_SYNONYM = f"CASE WHEN w IS NOT NULL AND length({_FIRST}) < length(s) THEN {_FIRST} || CASE WHEN {_MATCH} = upper({_MATCH}) THEN {_UP.format(f'({_OTHER})')} ELSE {_OTHER} END || substr(s, length({_FIRST}) + length(w) + 1) END"
_CLAUSES = f"""CASE WHEN {_fits(L.LEADING_WORD)} THEN {_part(L.LEADING_WORD, 2)} || ', ' || lower({_part(L.LEADING_WORD, 1)})
  WHEN {_fits(L.LEADING_CLAUSE)} THEN {_part(L.LEADING_CLAUSE, 3)} || ', ' || lower({_part(L.LEADING_CLAUSE, 1)}) || ' ' || {_part(L.LEADING_CLAUSE, 2)}
  WHEN {_fits(L.LATER_CLAUSE)} THEN {_UP.format(_part(L.LATER_CLAUSE, 2))} || ' ' || {_part(L.LATER_CLAUSE, 3)} || ', ' || lower({_part(L.LATER_CLAUSE, 1)}) END"""
_COMMA = "CASE WHEN contains(s, ', ') THEN regexp_replace(s, ', ', ' ') WHEN contains(s, ' and ') THEN regexp_replace(s, ' and ', ', and ') WHEN contains(s, ' but ') THEN regexp_replace(s, ' but ', ', but ') END"
_SWAP = f"regexp_replace(s, {_re2('(?i)' + L.TWO_BEFORE_NOUN)}, '\\2 \\1 \\3')"
_MOVED = f"{_UP.format(_part(L.SECOND_ADVERB, 2))} || ', ' || lower({_part(L.SECOND_ADVERB, 1)}) || ' ' || substr(s, length({_part(L.SECOND_ADVERB, 0)}) + 1)"
_SWAPPED = f"CASE WHEN {_SWAP} <> s THEN {_SWAP} WHEN {_fits(L.SECOND_ADVERB)} THEN {_MOVED} END"
_CONCEPTS = "list_distinct(list_filter({0}, lambda t: length(t) > 3 AND t NOT IN (" + ", ".join(map(_q, L.NO_CONCEPTS)) + ")))"
_GRAMS = "list_distinct(list_transform(list_zip({0}[:-2], {0}[2:]), lambda z: z[1] || ' ' || z[2]))"
_EVEN = lambda w: f"CASE WHEN s >= {w} THEN 1 - {_norm(f'w{w}', 0, 50)} ELSE 0 END"


def _window(w: int) -> str:
    return f"coalesce(avg(v{w}) FILTER (left_ >= {w}) + var_pop(v{w}) FILTER (left_ >= {w}), 0) AS w{w}"


def _variance(w: int) -> str:
    return f"var_pop(k) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS v{w}"


STABILITY = rf"""
WITH {BASE},
f AS (SELECT doc_id, no, s, list_filter(list_transform(string_split_regex(lower(s), '[{WS}]+'), lambda q: regexp_replace(q, '[^a-z]', '', 'g')), lambda q: q IN ({", ".join(map(_q, L.SYNONYM))}))[1] AS w FROM sent WHERE no <= 10),
va AS (
  SELECT doc_id, no, s, 1 AS t, {_SYNONYM} AS p FROM f UNION ALL SELECT doc_id, no, s, 2, {_CLAUSES} FROM f
  UNION ALL SELECT doc_id, no, s, 3, {_COMMA} FROM f WHERE no <= 8 UNION ALL SELECT doc_id, no, s, 4, {_SWAPPED} FROM f WHERE no <= 8),
pw AS (SELECT doc_id, no, t, {_WORDS.format("s")} AS a, {_WORDS.format("p")} AS b, {_tags("s")} AS c, {_tags("p")} AS e FROM va WHERE p IS NOT NULL AND p <> s),
m AS (
  SELECT doc_id, coalesce(0.2 * least(len(a), len(b)) / nullif(greatest(len(a), len(b)), 0), 0) + 0.4 * {_jaccard(_GRAMS.format("a"), _GRAMS.format("b"))}
      + 0.4 * len(list_filter(list_zip(c, e), lambda z: z[1] = z[2])) / greatest(len(c), len(e)) AS likeness,
    0.6 * (1 - {_jaccard(_CONCEPTS.format("a"), _CONCEPTS.format("b"))})
      + 0.4 * coalesce(list_avg(list_transform(list_filter(a, lambda q: length(q) > 4), lambda q: CASE WHEN list_contains(b, q) THEN abs((list_position(a, q) - 1) / len(a) - (list_position(b, q) - 1) / len(b)) ELSE 0.5 END)), 0) AS moves
  FROM pw),
mm AS (SELECT doc_id, count(*) AS n, avg(likeness) AS likeness, avg(moves) AS moves FROM m GROUP BY doc_id),
al AS (SELECT doc_id, avg(j) AS alike FROM (SELECT x.doc_id, x.no, avg({_jaccard("x.b", "y.b")}) AS j FROM pw x JOIN pw y ON x.doc_id = y.doc_id AND x.no = y.no AND x.t < y.t GROUP BY x.doc_id, x.no) GROUP BY doc_id),
kk AS (SELECT doc_id, no, len({_WORDS.format("s")})::DOUBLE AS k, count(*) OVER (PARTITION BY doc_id) - no + 1 AS left_ FROM sent),
wi AS (SELECT *, {", ".join(map(_variance, (3, 5, 8)))} FROM kk),
w AS (SELECT doc_id, count(*) AS s, {", ".join(map(_window, (3, 5, 8)))} FROM wi GROUP BY doc_id),
x AS (
  SELECT d.doc_id, length(text) AS len_, coalesce(s, 0) AS s, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN {_norm("likeness", 0.5, 0.9)} ELSE 0.5 END AS structure, CASE WHEN n > 0 THEN 1 - moves ELSE 0.5 END AS meaning,
    CASE WHEN n > 0 THEN {_norm("coalesce(alike, 0.5)", 0.4, 0.85)} ELSE 0.5 END AS recovery, ({" + ".join(f"({_EVEN(k)})" for k in (3, 5, 8))}) / greatest((s >= 3)::INT + (s >= 5)::INT + (s >= 8)::INT, 1) AS even_
  FROM d LEFT JOIN mm USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN w USING (doc_id))
{_row("Contrastive Instability", 15, "len_ >= 200 AND s >= 5", "0.3 * structure + 0.25 * meaning + 0.25 * recovery + 0.2 * even_", "CASE WHEN n < 5 THEN 0.3 WHEN s < 10 THEN 0.5 WHEN s < 20 THEN 0.7 ELSE 0.85 END", "x")}"""
