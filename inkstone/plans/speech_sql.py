"""DuckDB SQL of the correction for formal speeches."""

from __future__ import annotations

from inkstone.functions import speech_lists as L
from inkstone.plans.artifact_sql import _plain
from inkstone.plans.category_sql import _n
from inkstone.plans.lexical_sql import _re2


def _ascii(p: str) -> str:
    return p.replace(r"\w", "[A-Za-z0-9_]")


_MANY = lambda patterns: _n("low", [_ascii(p) for p in patterns])
SPEECH = f"""
WITH d AS (SELECT doc_id, {_plain("lower(coalesce(text, ''))")} AS low FROM documents),
x AS (SELECT doc_id, {" + ".join(f"{w} * {_MANY(patterns)}" for w, patterns in L.SPEECH_SIGNS.items())} AS speech, {_MANY(L.STUDENT_SIGNS)} AS n_student, {_MANY(L.UNCERTAIN_SIGNS)} AS n_uncertain,
  ({" OR ".join(f"regexp_matches(low, {_re2(_ascii(p))})" for p in L.INTRODUCTION_SIGNS)}) AS introduced FROM d)
SELECT doc_id, speech::INTEGER AS speech, n_student::INTEGER AS n_student, n_uncertain::INTEGER AS n_uncertain, introduced,
  round(least(0.6, CASE WHEN speech >= 6 THEN least(0.5, speech * 0.05) WHEN speech >= 3 THEN least(0.3, speech * 0.05) ELSE 0 END + CASE WHEN n_student >= 3 THEN least(0.2, n_student * 0.04) ELSE 0 END
    + CASE WHEN introduced THEN 0.1 ELSE 0 END + CASE WHEN n_uncertain >= 2 THEN least(0.1, n_uncertain * 0.02) ELSE 0 END)::DOUBLE + 1e-9, 6) AS correction
FROM x"""
