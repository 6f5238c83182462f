"""DuckDB SQL of the features of rewritten texts."""

from __future__ import annotations

from inkstone.functions import artifact_lists as L
from inkstone.functions.segment import WS
from inkstone.operators.artifact_features import NAMES
from inkstone.plans.category_sql import _in
from inkstone.plans.lexical_sql import _q, _re2
from inkstone.plans.oracles import trimmed
from inkstone.plans.style_sql import _listed

_R = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
#: Blocks of letters and digits beyond ASCII.
_OTHER = r"[\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{373}\x{376}-\x{37D}\x{386}\x{388}-\x{481}\x{48A}-\x{559}\x{561}-\x{587}\x{5D0}-\x{5EA}\x{620}-\x{64A}\x{1E00}-\x{1FBC}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]"
_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda q: regexp_matches(q, '^[a-z]+$'))"


def _plain(x: str) -> str:
    return f"regexp_replace({x}, '{_OTHER}', '0', 'g')"


def _times(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {_re2(p)}))"


def _half(k: int) -> str:
    words = _WORDS.format(f"h{k}")
    return f"{_listed(L.WORDS['formal'], words)} / greatest(len({words}), 1) AS formal{k}, {_times(_plain(f'h{k}'), L.CONTRACTION)} / greatest(len({words}), 1) AS short{k}"


_density = lambda c: f"{c} / n * 100"
_both = lambda a, b: f"CASE WHEN {a} AND {b} THEN 1 ELSE 0 END"
_repeats = lambda k: f"CASE WHEN m >= 5 THEN coalesce(r{k}, 0) ELSE 0 END"
_F = {
    "char_count": "length(text)", "word_count": "m", "sentence_count": "s", "avg_word_length": "coalesce(list_avg(k), 0)", "avg_sentence_length": "m / s", "unique_word_ratio": "len(list_distinct(w)) / n",
    "hapax_ratio": "coalesce(hapax, 0) / n", "sentence_length_std": "coalesce(list_stddev_pop(sizes), 0)", "sentence_length_range": "coalesce(list_max(sizes) - list_min(sizes), 0)",
    "burstiness_coef": "coalesce(list_stddev_pop(sizes) / nullif(list_avg(sizes), 0), 0)", "ai_phrase_count": "phrases", "ai_phrase_density": _density("phrases"), "formal_word_count": "formal",
    "formal_word_density": _density("formal"), "transition_density": _density("transition"), "sentence_start_variety": "CASE WHEN len(sent) > 2 THEN starts / s ELSE 1 END",
    "passive_voice_density": _density(_in("low", L.PASSIVES)), "contraction_count": "short", "contraction_density": _density("short"), "informal_contraction_count": "casual",
    "informal_contraction_density": _density("casual"), "contraction_distribution_std": "CASE WHEN len(sent) > 2 THEN list_stddev_pop(per) ELSE 0 END", "disfluency_count": "len(said)",
    "disfluency_density": _density("len(said)"), "sentence_start_disfluency_count": "opened", "sentence_start_disfluency_ratio": "opened / s", "disfluency_variety": "len(list_distinct(said)) / greatest(len(said), 1)",
    "typo_count": "typo", "typo_density": _density("typo"), "typo_position_variance": "coalesce(list_stddev_pop(gaps), 0)", "hedging_count": "hedging", "hedging_density": _density("hedging"),
    "emphatic_count": "emphatic", "emphatic_density": _density("emphatic"), "rhetorical_question_count": "asked", "rhetorical_question_density": "asked / s", "slang_count": "slang", "slang_density": _density("slang"),
    "fragment_count": "fragments", "fragment_density": "fragments / s", **{k: f"len(regexp_extract_all(text, {_q(p)}))" for k, p in L.SIGNS.items()}, "formal_slang_product": "formal * slang / n",
    "register_inconsistency": "abs(formal / n - slang / n)", "formality_shift": "CASE WHEN len(sent) >= 4 THEN abs(formal1 - formal2) ELSE 0 END", "contraction_shift": "CASE WHEN len(sent) >= 4 THEN abs(short1 - short2) ELSE 0 END",
    "ai_human_cooccurrence": "phrases * (len(said) + casual) / n", "formal_structure_casual_language": _both(f"{_in('low', L.STRUCTURE)} > 0", "casual + slang > 0"), "technical_with_typos": _both("formal >= 3", "typo >= 1"),
    "long_sentences_with_disfluencies": _both("m / s > 20", "len(said) >= 3"), "deliberate_typo_score": _density("typo"),
    "hedge_uniformity": "CASE WHEN len(sent) > 3 THEN greatest(0, least(1, 1 - list_stddev_pop(hedges) / (list_avg(hedges) + 0.001))) ELSE 0.5 END", "rhetorical_formal_combo": _both("asked >= 2", "formal >= 3"),
    "contractions_with_ai_phrases": _both("short >= 5", "phrases >= 1"), "word_length_variance": "CASE WHEN m >= 5 THEN list_var_pop(k) ELSE 0 END", "word_rarity_variance": "CASE WHEN m >= 5 THEN list_var_pop(rare) ELSE 0 END",
    "bigram_repeat_ratio": _repeats(2), "trigram_repeat_ratio": _repeats(3),
}
_SIGNALS = [_F[k] for k in ("formal_structure_casual_language", "technical_with_typos", "long_sentences_with_disfluencies", "rhetorical_formal_combo", "contractions_with_ai_phrases")]
_F["composite_humanization_score"] = "(" + " + ".join(f"({x})" for x in _SIGNALS) + " + least(typo / n * 100 / 2, 1)) / 6"

ARTIFACTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, text, lower(text) AS low, {_plain("text")} AS plain, {_WORDS.format("text")} AS w,
    list_filter(list_transform(string_split_regex(text, '[.!?]+[{WS}]+|[.!?]+$'), lambda q: {trimmed("q")}), lambda q: q <> '') AS sent FROM d),
b AS (
  SELECT *, len(w)::DOUBLE AS m, greatest(len(w), 1)::DOUBLE AS n, greatest(len(sent), 1)::DOUBLE AS s, list_transform(w, lambda q: length(q)::DOUBLE) AS k,
    list_transform(sent, lambda q: len(regexp_extract_all(q, '[^{WS}]+'))::DOUBLE) AS sizes, len(list_distinct(list_transform(sent, lambda q: lower(string_split_regex(q, '[{WS}]+')[1])))) AS starts,
    list_transform(sent, lambda q: {_times(_plain("q"), L.CONTRACTION)}::DOUBLE) AS per, list_transform(sent, lambda q: {_listed(L.WORDS["hedging"], _WORDS.format("q"))}::DOUBLE) AS hedges,
    list_transform(regexp_extract_all(plain, {_re2(L.DISFLUENCY)}), lambda q: lower(q)) AS said,
    list_filter(list_transform(w, lambda q, i: CASE WHEN q IN ({", ".join(map(_q, L.WORDS["typo"]))}) THEN i END), lambda i: i IS NOT NULL) AS at_,
    array_to_string(sent[:len(sent) // 2], ' ') AS h1, array_to_string(sent[len(sent) // 2 + 1:], ' ') AS h2, list_transform(w, lambda q: (q IN ({", ".join(map(_q, L.WORDS["common"]))}))::INT::DOUBLE) AS rare,
    {", ".join(f"{_listed(ws, 'w')} AS {k}" for k, ws in L.WORDS.items() if k != "common")}, {_in("low", L.STOCK_PHRASES)} AS phrases, {_in("low", L.FRAGMENTS)} AS fragments,
    {_times("plain", L.CONTRACTION)} AS short, {_times("plain", L.CASUAL_CONTRACTION)} AS casual, {_times("plain", L.RHETORICAL)} AS asked, {_times("plain", "(?im)" + L.STARTING_DISFLUENCY)} AS opened
  FROM a),
c AS (SELECT *, list_transform(list_zip(at_[:-2], at_[2:]), lambda z: (z[2] - z[1])::DOUBLE) AS gaps, {_half(1)}, {_half(2)} FROM b),
x AS (SELECT doc_id, k, count(*) FILTER (c > 1) / sum(c) AS r FROM (
  SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS c FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM a, (VALUES (2), (3)) v(k)) GROUP BY ALL) GROUP BY doc_id, k),
y AS (SELECT doc_id, max(r) FILTER (k = 2) AS r2, max(r) FILTER (k = 3) AS r3 FROM x GROUP BY doc_id),
h AS (SELECT doc_id, count(*) FILTER (c = 1) AS hapax FROM (SELECT doc_id, q, count(*) AS c FROM (SELECT doc_id, unnest(w) AS q FROM a) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"{_R(f'CASE WHEN length({trimmed('text')}) >= 10 THEN {_F[k]} ELSE 0 END')} AS {k}" for k in NAMES)}
FROM c LEFT JOIN y USING (doc_id) LEFT JOIN h USING (doc_id)"""
