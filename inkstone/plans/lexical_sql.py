"""DuckDB SQL of the lexical counts, made from the same lists."""

from __future__ import annotations

from inkstone.functions import lexicons
from inkstone.functions.segment import WS
from inkstone.operators.lexical import _SINGLE, phrase_pattern
from inkstone.plans.oracles import trimmed

_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents)"
_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(low, '[a-z0-9_]+')) AS w FROM d)"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _re2(p: str) -> str:
    return _q(p.replace(r"[^aeiou\s]", f"[^aeiou{WS}]").replace(r"\s", f"[{WS}]").replace("\\u2026", "…"))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"({_q(a)}, {_q(b)})" for a, b in sorted(set(rows)))


_LISTS = _values([(n, w) for n, ws in {**lexicons.WORDS, **lexicons.PRESENT}.items() for w in ws if _SINGLE.fullmatch(w)])
WORD_COUNTS = f"""
WITH {_DOCS}, {_TOK}, l(name, w) AS (VALUES {_LISTS})
SELECT doc_id, name, count(*)::BIGINT AS n, count(DISTINCT w)::BIGINT AS n_distinct FROM tok JOIN l USING (w) GROUP BY doc_id, name"""

STEM_COUNTS = f"""
WITH {_DOCS}, {_TOK}, l(name, stem) AS (VALUES {_values([(n, w) for n, ws in lexicons.STEMS.items() for w in ws])})
SELECT doc_id, name, count(*)::BIGINT AS n FROM tok JOIN l ON starts_with(w, stem) GROUP BY doc_id, name"""


def _long(columns: dict[str, str]) -> str:
    return "SELECT doc_id, name, n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {_q(k)} AS name, ({v})::BIGINT AS n FROM d" for k, v in columns.items()) + ") WHERE n > 0"


PHRASE_COUNTS = f"WITH {_DOCS} " + _long(
    {
        n: " + ".join(f"len(regexp_extract_all(low, {_re2(phrase_pattern(w))}))" for w in ws if not _SINGLE.fullmatch(w))
        for n, ws in lexicons.WORDS.items()
        if any(not _SINGLE.fullmatch(w) for w in ws)
    }
)
CONTAINED = f"WITH {_DOCS} " + _long({n: " + ".join(f"contains(low, {_q(w)})::INT" for w in ws) for n, ws in lexicons.CONTAINED.items()})
PATTERN_COUNTS = f"WITH {_DOCS} " + _long({n: " + ".join(f"len(regexp_extract_all(text, {_re2(p)}))" for p in ps) for n, ps in lexicons.PATTERNS.items()})

_SYL = """CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(lower(x), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END"""
_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
READABILITY = rf"""
WITH {_DOCS},
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS x FROM d),
g AS (
  SELECT doc_id, count(*)::DOUBLE AS n, sum(y) AS y, count(*) FILTER (y >= 3) AS poly, count(*) FILTER (length(x) > 5) AS o5, count(*) FILTER (length(x) > 6) AS o6, count(*) FILTER (length(x) > 7) AS o7
  FROM (SELECT doc_id, x, {_SYL} AS y FROM w) GROUP BY doc_id),
j AS (
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(y, 0) AS y, coalesce(poly, 0) AS poly, coalesce(o5, 0) AS o5, coalesce(o6, 0) AS o6, coalesce(o7, 0) AS o7,
    len(list_filter(string_split_regex(text, '[.!?]+'), lambda p: {trimmed("p")} <> ''))::DOUBLE AS s,
    len(regexp_extract_all(text, '[a-zA-Z]')) AS letters, len(regexp_extract_all(text, '[a-zA-Z0-9]')) AS signs
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, s::BIGINT AS n_sentences, y::BIGINT AS n_syllables,
  {_R("CASE WHEN n > 0 AND s > 0 THEN 206.835 - 1.015 * n / s - 84.6 * y / n ELSE 0 END")} AS reading_ease, {_R("CASE WHEN n > 0 AND s > 0 THEN 0.39 * n / s + 11.8 * y / n - 15.59 ELSE 0 END")} AS grade,
  {_R("CASE WHEN n > 0 AND s > 0 THEN 0.4 * (n / s + 100 * poly / n) ELSE 0 END")} AS fog, {_R("CASE WHEN s >= 3 THEN 1.0430 * sqrt(poly * 30 / s) + 3.1291 ELSE 0 END")} AS smog,
  {_R("CASE WHEN n > 0 THEN 5.88 * letters / n - 29.6 * s / n - 15.8 ELSE 0 END")} AS coleman_liau, {_R("CASE WHEN n > 0 AND s > 0 THEN 4.71 * signs / n + 0.5 * n / s - 21.43 ELSE 0 END")} AS automated,
  {_R("CASE WHEN n > 0 AND s > 0 THEN 15.79 * o7 / n + 0.0496 * n / s ELSE 0 END")} AS dale_chall, {_R("CASE WHEN n > 0 AND s > 0 THEN n / s + o6 * 100 / n ELSE 0 END")} AS lix,
  {_R("CASE WHEN s > 0 THEN o6 / s ELSE 0 END")} AS rix, {_R("CASE WHEN n > 0 AND s > 0 THEN 0.141 * n / s + 8.6 * o5 / n + 0.839 ELSE 0 END")} AS spache
FROM j"""
