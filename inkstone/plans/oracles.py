"""DuckDB SQL that recomputes the queries from grouped rows instead of arrays."""

from __future__ import annotations

from inkstone.functions.segment import ABBREVIATIONS, WS

_MARK = "chr(1)"


def _masked(text: str) -> str:
    for i, a in enumerate(ABBREVIATIONS):
        text = f"replace({text}, '{a}', {_MARK} || '{chr(97 + i)}' || {_MARK})"
    return text


def _restored(text: str) -> str:
    for i, a in enumerate(ABBREVIATIONS):
        text = f"replace({text}, {_MARK} || '{chr(97 + i)}' || {_MARK}, '{a}')"
    return text


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


#: d(doc_id, text), tok(doc_id, pos, w), sent(doc_id, no, s, n)
BASE = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tok AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_''-]+') AS ws FROM d)),
sent AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, s, len(regexp_extract_all(s, '[^{WS}]+')) AS n
  FROM (
    SELECT doc_id, i, {trimmed(_restored("piece"))} AS s
    FROM (
      SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece
      FROM (SELECT doc_id, string_split(regexp_replace({_masked("text")}, '([.!?])[{WS}]+([A-Z])', '\1' || chr(2) || '\2', 'g'), chr(2)) AS ps
            FROM d WHERE {trimmed("text")} <> '')))
  WHERE s <> '')"""

_SYLLABLES = """CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))
  - CASE WHEN x LIKE '%e' AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"""


def _likely(x: str, mean: float, std: float, low: float, high: float) -> str:
    return f"""(exp(-pow(({x} - ({mean})) / {std}, 2) / 2) * (1 - 0.5 * least(1, CASE WHEN {x} < {low} THEN ({low} - ({x})) / {2 * std}
      WHEN {x} > {high} THEN ({x} - ({high})) / {2 * std} ELSE 0 END)))"""


SCORES = rf"""
{BASE},
cnt AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY ALL),
voc AS (SELECT doc_id, sum(c) AS words, count(*) AS types, count(*) FILTER (c = 1) AS hapax FROM cnt GROUP BY doc_id),
syl AS (SELECT doc_id, sum({_SYLLABLES}) AS syllables FROM (SELECT doc_id, regexp_replace(w, '[^a-z]', '', 'g') AS x FROM tok) GROUP BY doc_id),
zipf AS (
  SELECT doc_id, CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) <> 0 THEN (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) END AS slope
  FROM (SELECT doc_id, ln(row_number() OVER (PARTITION BY doc_id ORDER BY c DESC)) AS x, ln(c) AS y FROM cnt
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) <= 100)
  GROUP BY doc_id),
gram AS (
  SELECT a.doc_id, count(*) FILTER (n = 2 AND c >= 3) AS repeated_pairs, count(*) FILTER (n = 3 AND c >= 2) AS repeated_triples
  FROM (
    SELECT doc_id, 2 AS n, w || ' ' || w2 AS g, count(*) AS c FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w2 FROM tok) WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL
    SELECT doc_id, 3, w || ' ' || w2 || ' ' || w3, count(*)
    FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3 FROM tok) WHERE w3 IS NOT NULL GROUP BY ALL) a
  GROUP BY a.doc_id),
len AS (
  SELECT doc_id, count(*) AS ns, avg(n) AS m, stddev_pop(n) AS sd, median(n) AS md FROM sent GROUP BY doc_id),
st AS (
  SELECT doc_id, max(c) AS top FROM (
    SELECT doc_id, lower(array_to_string(regexp_extract_all(s, '[^{WS}]+')[1:2], ' ')) AS k, count(*) AS c FROM sent GROUP BY ALL) GROUP BY doc_id),
loc AS (
  SELECT doc_id, count(*) AS k, avg(v) AS m, var_pop(v) AS vv FROM (
    SELECT doc_id, var_pop(n) OVER f AS v, count(*) OVER f AS k FROM sent WINDOW f AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE k = 5 GROUP BY doc_id),
para AS (
  SELECT doc_id, len(list_filter(string_split_regex(text, '\n[{WS}]*\n'), lambda p: {trimmed("p")} <> '')) AS k FROM d),
f AS (
  SELECT d.doc_id, {trimmed("d.text")} = '' AS blank, length(d.text) + len(regexp_extract_all(d.text, '[\x{{10000}}-\x{{10FFFF}}]')) AS characters,
    coalesce(words, 0) AS nw, coalesce(types, 0) AS types, coalesce(hapax, 0) AS hapax, coalesce(ns, 0) AS ns, coalesce(para.k, 0) AS n_paragraphs,
    coalesce(repeated_pairs, 0) AS repeated_pairs, coalesce(repeated_triples, 0) AS repeated_triples, slope,
    coalesce(len.m, 0) AS lm, coalesce(sd, 0) AS ls, coalesce(md, 0) AS lmed, coalesce(top, 0) AS top,
    CASE WHEN ns >= 2 AND len.m <> 0 THEN sd / len.m ELSE 0 END AS cv,
    CASE WHEN ns >= 2 AND sd + len.m <> 0 THEN (sd - len.m) / (sd + len.m) ELSE 0 END AS burst,
    CASE WHEN ns >= 2 THEN 1 - least(1, (CASE WHEN len.m <> 0 THEN sd / len.m ELSE 0 END) / 0.8) ELSE 0.5 END AS unif,
    CASE WHEN words > 0 THEN types / words ELSE 0 END AS ttr, CASE WHEN types > 0 THEN hapax / types ELSE 0 END AS hpt,
    CASE WHEN ns > 0 THEN top / ns ELSE 0 END AS share, CASE WHEN words > 0 THEN syllables / words ELSE 0 END AS spw,
    coalesce(words, 0) / greatest(1, coalesce(ns, 0)) AS wps, coalesce(loc.k, 0) AS nloc, loc.m AS locm, loc.vv AS locv
  FROM d LEFT JOIN voc USING (doc_id) LEFT JOIN syl USING (doc_id) LEFT JOIN zipf USING (doc_id) LEFT JOIN gram USING (doc_id)
  LEFT JOIN len USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN loc USING (doc_id) LEFT JOIN para USING (doc_id)),
sc AS (
  SELECT *,
    CASE WHEN ns >= 3 THEN 1 - {_likely("cv", 0.55, 0.15, 0.25, 0.85)} ELSE 0.5 END AS p1, CASE WHEN ns >= 3 THEN least(0.9, 0.5 + ns / 50) ELSE 0.3 END AS c1,
    CASE WHEN nw >= 20 THEN 1 - {_likely("hpt", 0.48, 0.08, 0.30, 0.65)} ELSE 0.5 END AS p2, CASE WHEN nw >= 20 THEN least(0.85, 0.4 + nw / 500) ELSE 0.3 END AS c2,
    CASE WHEN nw >= 50 AND slope IS NOT NULL THEN 1 - {_likely("slope", -1.0, 0.15, -1.3, -0.7)} ELSE 0.5 END AS p3, CASE WHEN nw >= 50 THEN 0.7 ELSE 0.3 END AS c3,
    CASE WHEN ns >= 5 THEN 1 - {_likely("burst", 0.15, 0.12, -0.10, 0.40)} ELSE 0.5 END AS p4, CASE WHEN ns >= 5 THEN 0.65 ELSE 0.3 END AS c4,
    least(0.9, 0.3 + CASE WHEN repeated_triples > 5 THEN 0.3 ELSE 0 END + CASE WHEN share > 0.3 AND ns >= 5 THEN 0.2 ELSE 0 END) AS p5, 0.6 AS c5,
    unif * 0.7 + 0.15 AS p6, 0.55 AS c6
  FROM f),
an AS (
  SELECT *, CASE WHEN blank THEN 0 ELSE (p1 * .22 * c1 + p2 * .18 * c2 + p3 * .12 * c3 + p4 * .18 * c4 + p5 * .15 * c5 + p6 * .15 * c6)
      / (.22 * c1 + .18 * c2 + .12 * c3 + .18 * c4 + .15 * c5 + .15 * c6) END AS p,
    CASE WHEN blank THEN 0 ELSE least(0.95, (c1 + c2 + c3 + c4 + c5 + c6) / 6 + least(0.2, ns / 100)) END AS c,
    nloc >= 3 AND cv > 0.6 AND locm > 0 AND locv < 0.3 * locm AS stable, abs(p2 - p1) > 0.4 AS broken
  FROM sc)"""

_WILSON = "(p + 3.8416 / (2 * greatest(1, ns))) / (1 + 3.8416 / greatest(1, ns)) {0} 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * greatest(1, ns))) / greatest(1, ns)) / (1 + 3.8416 / greatest(1, ns))"

ANALYSIS = rf"""
WITH {SCORES}
SELECT doc_id, round(p::DOUBLE + 1e-9, 6) AS ai_probability, round(1 - p::DOUBLE + 1e-9, 6) AS human_probability, round(c::DOUBLE + 1e-9, 6) AS confidence,
  CASE WHEN NOT blank THEN round(greatest(0, {_WILSON.format("-")})::DOUBLE + 1e-9, 6) END AS ci_lower,
  CASE WHEN NOT blank THEN round(least(1, {_WILSON.format("+")})::DOUBLE + 1e-9, 6) END AS ci_upper,
  CASE WHEN blank THEN 'Unknown' WHEN p < .2 THEN 'Human' WHEN p < .35 THEN 'Probably Human' WHEN p < .5 THEN 'Possibly Mixed'
       WHEN p < .65 THEN 'Possibly AI' WHEN p < .8 THEN 'Probably AI' ELSE 'AI' END AS verdict,
  CASE WHEN blank THEN NULL WHEN p < .2 THEN 'high' WHEN p < .35 THEN 'moderate' WHEN p < .65 THEN 'low' WHEN p < .8 THEN 'moderate' ELSE 'high' END AS verdict_confidence,
  characters::BIGINT AS characters, nw::BIGINT AS words, ns::BIGINT AS n_sentences, n_paragraphs::BIGINT AS n_paragraphs, types::BIGINT AS types, hapax::BIGINT AS hapax,
  repeated_pairs::BIGINT AS repeated_pairs, repeated_triples::BIGINT AS repeated_triples,
  round(lm::DOUBLE + 1e-9, 6) AS len_mean, round(lmed::DOUBLE + 1e-9, 6) AS len_median, round(ls::DOUBLE + 1e-9, 6) AS len_std, round(cv::DOUBLE + 1e-9, 6) AS len_cv, round(burst::DOUBLE + 1e-9, 6) AS len_burst,
  round(unif::DOUBLE + 1e-9, 6) AS len_uniformity, round(ttr::DOUBLE + 1e-9, 6) AS ttr, round(hpt::DOUBLE + 1e-9, 6) AS hapax_per_type, round(slope::DOUBLE + 1e-9, 6) AS slope, round(spw::DOUBLE + 1e-9, 6) AS syllables_per_word,
  round((0.39 * wps + 11.8 * spw - 15.59)::DOUBLE + 1e-9, 6) AS grade_level, round((206.835 - 1.015 * wps - 84.6 * spw)::DOUBLE + 1e-9, 6) AS reading_ease,
  coalesce(stable, false) AND NOT blank AS stable_variance, broken AND NOT blank AS broken_correlation, coalesce(stable, false) AND broken AND NOT blank AS likely_humanized
FROM an"""

_CATEGORIES = (("Sentence Structure", 2, 1), ("Vocabulary Richness", 3, 2), ("Zipf''s Law Analysis", 8, 3), ("Burstiness Patterns", 9, 4), ("Repetition Patterns", 12, 5), ("Readability Analysis", 7, 6))
CATEGORY_SCORES = f"WITH {SCORES}\n" + "\nUNION ALL\n".join(
    f"SELECT doc_id, '{name}' AS name, {number}::INTEGER AS category, round(p{k}::DOUBLE + 1e-9, 6) AS ai_probability, round(c{k}::DOUBLE + 1e-9, 6) AS confidence FROM sc WHERE NOT blank" for name, number, k in _CATEGORIES
)


def _note(when: str, category: int, indicator: str, text: str) -> str:
    return f"SELECT doc_id, {category}::INTEGER AS category, '{indicator}' AS indicator, {text} AS text FROM sc WHERE NOT blank AND ({when})"


def _num(x: str, digits: int, unit: str = "") -> str:
    return f"printf('%.{digits}f', round(({x})::DOUBLE, {digits}) + 0.0) || '{unit}'"


_CV, _HAPAX, _SLOPE, _BURST, _GRADE = _num("cv", 3), _num("hpt * 100", 1, "%"), _num("slope", 2), _num("burst", 3), "0.39 * wps + 11.8 * spw - 15.59"
_NOTES = [
    ("ns < 3", 2, "neutral", "'too few sentences'"),
    ("ns >= 3 AND cv < 0.25", 2, "ai", f"'sentence lengths too even, cv ' || {_CV}"),
    ("ns >= 3 AND cv > 0.85", 2, "mixed", f"'sentence lengths too uneven, cv ' || {_CV}"),
    ("ns >= 3 AND cv BETWEEN 0.25 AND 0.85", 2, "human", f"'natural sentence lengths, cv ' || {_CV}"),
    ("ns >= 3 AND unif > 0.7", 2, "ai", f"'uniformity ' || {_num('unif * 100', 0, '%')}"),
    ("nw < 20", 3, "neutral", "'too few words'"),
    ("nw >= 20 AND hpt < 0.3", 3, "ai", f"'few words used once, ' || {_HAPAX}"),
    ("nw >= 20 AND hpt > 0.65", 3, "mixed", f"'very many words used once, ' || {_HAPAX}"),
    ("nw >= 20 AND hpt BETWEEN 0.3 AND 0.65", 3, "human", f"'natural share of words used once, ' || {_HAPAX}"),
    ("nw >= 20 AND ttr < 0.25", 3, "ai", f"'little variety of words, ' || {_num('ttr', 3)}"),
    ("nw >= 20 AND ttr > 0.6", 3, "mixed", f"'unusual variety of words, ' || {_num('ttr', 3)}"),
    ("nw < 50", 8, "neutral", "'too few words'"),
    ("nw >= 50 AND slope > -0.7", 8, "ai", f"'word frequencies too flat, slope ' || {_SLOPE}"),
    ("nw >= 50 AND slope < -1.3", 8, "mixed", f"'word frequencies too steep, slope ' || {_SLOPE}"),
    ("nw >= 50 AND slope BETWEEN -1.3 AND -0.7", 8, "human", f"'natural word frequencies, slope ' || {_SLOPE}"),
    ("ns < 5", 9, "neutral", "'too few sentences'"),
    ("ns >= 5 AND burst < -0.1", 9, "ai", f"'periodic sentence lengths, ' || {_BURST}"),
    ("ns >= 5 AND burst > 0.4", 9, "mixed", f"'chaotic sentence lengths, ' || {_BURST}"),
    ("ns >= 5 AND burst BETWEEN -0.1 AND 0.4", 9, "human", f"'natural bursts, ' || {_BURST}"),
    ("repeated_triples > 5", 12, "ai", "repeated_triples::VARCHAR || ' repeated phrases of three words'"),
    ("share > 0.3 AND ns >= 5", 12, "ai", f"{_num('share * 100', 0, '%')} || ' of sentences start alike'"),
    ("repeated_triples <= 5 AND NOT (share > 0.3 AND ns >= 5)", 12, "human", "'natural variety of phrases'"),
    ("cv < 0.25", 7, "ai", f"'very even complexity, cv ' || {_num('cv', 2)}"),
    ("cv > 1", 7, "mixed", f"'very uneven complexity, cv ' || {_num('cv', 2)}"),
    ("cv BETWEEN 0.25 AND 1", 7, "human", f"'natural complexity, cv ' || {_num('cv', 2)}"),
    (f"{_GRADE} BETWEEN 8 AND 14", 7, "human", f"'grade ' || {_num(_GRADE, 1)}"),
]
FINDINGS = f"WITH {SCORES}\n" + "\nUNION ALL\n".join(_note(*n) for n in _NOTES)

_D = lambda x: f"round(({x})::DOUBLE + 1e-9, 6)"
VOCABULARY = rf"""
WITH {BASE},
cnt AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY ALL),
voc AS (SELECT doc_id, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, count(*) FILTER (c = 1) AS v1, count(*) FILTER (c = 2) AS v2, sum(c * c)::DOUBLE AS m2, sum(c * length(w)) AS letters FROM cnt GROUP BY doc_id),
ent AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS bits FROM cnt JOIN voc USING (doc_id) GROUP BY doc_id),
seg AS (SELECT doc_id, avg(t) AS t FROM (SELECT doc_id, (pos - 1) // 50 AS k, count(DISTINCT w) / 50 AS t, count(*) AS m FROM tok GROUP BY ALL) WHERE m = 50 GROUP BY doc_id),
zipf AS (
  SELECT doc_id, count(*) AS k, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy FROM (
    SELECT doc_id, ln(row_number() OVER (PARTITION BY doc_id ORDER BY c DESC)) AS x, ln(c) AS y FROM cnt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) <= 50)
  GROUP BY doc_id),
j AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(v1, 0) AS v1, coalesce(v2, 0) AS v2, coalesce(m2, 0) AS m2, coalesce(letters, 0) AS letters, coalesce(bits, 0) AS bits, seg.t, k,
    CASE WHEN n >= 20 AND k > 1 THEN slope ELSE 0 END AS slope, CASE WHEN n >= 20 AND k > 1 AND syy * k > 1e-9 THEN r2 ELSE 0 END AS r2
  FROM d LEFT JOIN voc USING (doc_id) LEFT JOIN ent USING (doc_id) LEFT JOIN seg USING (doc_id) LEFT JOIN zipf USING (doc_id))
SELECT doc_id, n::BIGINT AS n_tokens, v::BIGINT AS n_types,
  {_D("CASE WHEN n > 0 THEN v / n ELSE 0 END")} AS ttr, {_D("CASE WHEN n > 0 THEN v / sqrt(n) ELSE 0 END")} AS root_ttr, {_D("CASE WHEN n >= 2 THEN ln(v) / ln(n) ELSE 0 END")} AS log_ttr,
  {_D("CASE WHEN n >= 50 THEN t WHEN n > 0 THEN v / n ELSE 0 END")} AS msttr,
  {_D("CASE WHEN n > 0 THEN v1 / n ELSE 0 END")} AS hapax_per_token, {_D("CASE WHEN v > 0 THEN v1 / v ELSE 0 END")} AS hapax_per_type,
  {_D("CASE WHEN n > 0 THEN v2 / n ELSE 0 END")} AS dis_per_token, {_D("CASE WHEN v > 0 THEN v2 / v ELSE 0 END")} AS sichel_s,
  {_D("CASE WHEN n >= 10 THEN 10000 * (m2 - n) / (n * n) ELSE 0 END")} AS yule_k, {_D("CASE WHEN v > 0 THEN 10000 * (m2 - v) / (v * v) ELSE 0 END")} AS yule_k_types,
  {_D("CASE WHEN n >= 2 THEN (m2 - n) / (n * (n - 1)) ELSE 0 END")} AS simpson_d, {_D("CASE WHEN n >= 10 AND v1 < v THEN 100 * ln(n) / (1 - v1 / v) ELSE 0 END")} AS honore_r,
  {_D("CASE WHEN n >= 10 THEN pow(n, pow(v, -0.172)) ELSE 0 END")} AS brunet_w, {_D("CASE WHEN n > 0 THEN letters / n ELSE 0 END")} AS mean_word_length,
  {_D("bits")} AS entropy_bits, {_D("CASE WHEN v > 1 THEN bits / log2(v) ELSE 0 END")} AS normalized_entropy,
  {_D("slope")} AS zipf_slope, {_D("r2")} AS zipf_r2, {_D("CASE WHEN n >= 20 THEN 1 - least(1, abs(slope + 1)) ELSE 0.5 END")} AS zipf_compliance
FROM j"""

SEQUENCE = rf"""
WITH {BASE},
s AS (SELECT doc_id, no, len(regexp_extract_all(lower(s), '[a-z0-9_''-]+'))::DOUBLE AS x FROM sent),
g AS (
  SELECT doc_id, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, list(x ORDER BY x) AS o, list(x ORDER BY no) AS a
  FROM s GROUP BY doc_id),
mo AS (SELECT doc_id, sum(pow(x - m, 3)) AS s3, sum(pow(x - m, 4)) AS s4, sum(pow(x - m, 2) / nullif(m, 0)) AS chi FROM s JOIN g USING (doc_id) GROUP BY doc_id),
gi AS (SELECT doc_id, sum((2 * i - n - 1) * x) / (n * n * nullif(m, 0)) AS gini FROM (SELECT doc_id, n, m, unnest(o) AS x, unnest(range(1, len(o) + 1)) AS i FROM g) GROUP BY doc_id, n, m),
loc AS (
  SELECT doc_id, count(*) AS k, avg(v) AS m, stddev_pop(v) AS sd FROM (
    SELECT doc_id, var_pop(x) OVER f AS v, count(*) OVER f AS k FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5 GROUP BY doc_id),
lag AS (
  SELECT x.doc_id, k, sum((x.x - m) * (y.x - m)) / (any_value(n) * nullif(any_value(v), 0)) AS r, avg(1 - abs(x.x - y.x) / greatest(x.x, y.x, 1)) AS alike
  FROM s x JOIN s y ON x.doc_id = y.doc_id AND y.no - x.no BETWEEN 1 AND 10 JOIN g ON g.doc_id = x.doc_id, (SELECT unnest(range(1, 11)) AS k) WHERE y.no - x.no = k GROUP BY x.doc_id, k, m),
lags AS (SELECT doc_id, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 2) AS r2, max(abs(r)) AS rm, max(alike) FILTER (k >= 2) AS per FROM lag GROUP BY doc_id),
ru AS (
  SELECT doc_id, 1 + sum(CASE WHEN b <> p THEN 1 ELSE 0 END) AS runs, sum(b) AS n1 FROM (
    SELECT doc_id, no, (x > md)::INT AS b, lag((x > md)::INT) OVER (PARTITION BY doc_id ORDER BY no) AS p FROM s JOIN g USING (doc_id)) GROUP BY doc_id),
z AS (
  SELECT doc_id, runs, 2 * (n - n1) * n1 / n + 1 AS ex, 2 * (n - n1) * n1 * (2 * (n - n1) * n1 - n) / (n * n * nullif(n - 1, 0)) AS inner_ FROM ru JOIN g USING (doc_id)),
j AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(g.m, 0) AS m, coalesce(v, 0) AS v, sqrt(coalesce(v, 0)) AS sd, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi, coalesce(md, 0) AS md, coalesce(q1, 0) AS q1, coalesce(q3, 0) AS q3, o, a, s3, s4, chi, gini,
    loc.k AS lk, loc.m AS lm, loc.sd AS lsd, r1, r2, rm, per, runs, ex, inner_,
    CASE WHEN n >= 2 AND g.m <> 0 THEN sqrt(v) / g.m ELSE 0 END AS cv, CASE WHEN n >= 10 AND inner_ > 0 THEN (runs - ex) / sqrt(inner_) ELSE 0 END AS zz
  FROM d LEFT JOIN g USING (doc_id) LEFT JOIN mo USING (doc_id) LEFT JOIN gi USING (doc_id) LEFT JOIN loc USING (doc_id) LEFT JOIN lags USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT doc_id, n::BIGINT AS n_sentences, {_D("m")} AS mean, {_D("v")} AS variance, {_D("sd")} AS std, {_D("cv")} AS cv, lo::BIGINT AS shortest, hi::BIGINT AS longest,
  {_D("md")} AS median, {_D("q1")} AS p25, {_D("q3")} AS p75,
  {_D("CASE WHEN n >= 3 AND v > 0 THEN n / ((n - 1) * (n - 2)) * s3 / pow(sd, 3) ELSE 0 END")} AS skewness,
  {_D("CASE WHEN n >= 4 AND v > 0 THEN n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * s4 / (v * v) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) ELSE 0 END")} AS kurtosis,
  {_D("coalesce(gini, 0)")} AS gini,
  {_D("CASE WHEN n >= 2 AND sd + m <> 0 THEN (sd - m) / (sd + m) ELSE 0 END")} AS burstiness, {_D("CASE WHEN n >= 2 THEN 1 - least(1, cv / 0.8) ELSE 0.5 END")} AS uniformity,
  {_D("exp(-pow((cv - 0.55) / 0.15, 2) / 2)")} AS variance_naturalness,
  {_D("CASE WHEN n >= 4 AND hi > lo THEN (o[floor(n * 0.75)::INT + 1] - o[floor(n * 0.25)::INT + 1]) / (hi - lo) ELSE 0.5 END")} AS iqr_ratio,
  {_D("CASE WHEN lk >= 2 THEN 1 - least(1, (CASE WHEN lm <> 0 THEN lsd / lm ELSE 0 END) / 0.8) ELSE 0.5 END")} AS variance_stability,
  {_D("CASE WHEN n >= 20 AND m <> 0 THEN least(1, abs(list_avg(a[-10:]) - list_avg(a[1:10])) / m) ELSE 0 END")} AS drift,
  {_D("CASE WHEN n >= 20 THEN greatest(0, per) ELSE 0 END")} AS periodicity,
  {_D("CASE WHEN n >= 15 AND v > 0 THEN r1 ELSE 0 END")} AS lag1, {_D("CASE WHEN n >= 15 AND v > 0 THEN r2 ELSE 0 END")} AS lag2,
  {_D("CASE WHEN n >= 15 AND v > 0 THEN rm WHEN n >= 15 THEN 1 ELSE 0 END")} AS max_autocorrelation,
  CASE WHEN n >= 10 THEN runs ELSE 0 END::BIGINT AS runs, {_D("zz")} AS runs_z, abs(zz) < 1.96 AS runs_random,
  {_D("CASE WHEN n >= 3 AND m > 0 THEN 1 / (1 + chi / (n - 1)) ELSE 0 END")} AS chi_uniformity
FROM j"""

_GRAMS = "\n  UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM arr WHERE len(ws) >= {n})" for n in (2, 3, 4, 5, 6)
)
_GRAM_BASE = rf"""{BASE},
arr AS (SELECT doc_id, list(w ORDER BY pos) AS ws FROM tok GROUP BY doc_id),
grams AS ({_GRAMS}),
gc AS (SELECT doc_id, n, g, count(*) AS c FROM grams GROUP BY ALL)"""
NGRAMS = rf"""
WITH {_GRAM_BASE},
t AS (SELECT doc_id, n, sum(c)::DOUBLE AS total, count(*) AS dist, count(*) FILTER (c > 1) AS rep, coalesce(sum(c) FILTER (c > 1), 0) AS cov FROM gc GROUP BY doc_id, n),
e AS (SELECT doc_id, n, -sum(c / total * log2(c / total)) AS h FROM gc JOIN t USING (doc_id, n) GROUP BY doc_id, n),
k AS (SELECT doc_id, n FROM d, (SELECT unnest([2, 3, 4, 5]) AS n))
SELECT doc_id, n::INTEGER AS n, coalesce(total, 0)::BIGINT AS total, coalesce(dist, 0)::BIGINT AS n_distinct, coalesce(rep, 0)::BIGINT AS repeated,
  {_D("CASE WHEN dist > 0 THEN rep / dist ELSE 0 END")} AS repeated_share, {_D("CASE WHEN total > 0 THEN cov / total ELSE 0 END")} AS covered, {_D("CASE WHEN total > 1 THEN h / log2(total) ELSE 0 END")} AS entropy
FROM k LEFT JOIN t USING (doc_id, n) LEFT JOIN e USING (doc_id, n)"""

PERPLEXITY = rf"""
WITH {BASE},
b AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM tok QUALIFY y IS NOT NULL),
c AS (SELECT doc_id, w, y, count(*) AS c FROM b GROUP BY ALL),
x AS (SELECT doc_id, w, sum(c) AS k FROM c GROUP BY ALL),
v AS (SELECT doc_id, count(*) AS v, sum(c) AS n FROM c GROUP BY doc_id),
h AS (SELECT doc_id, -sum(c * log2((c + 1) / (k + v))) / any_value(n) AS h FROM c JOIN x USING (doc_id, w) JOIN v USING (doc_id) GROUP BY doc_id),
t AS (SELECT d.doc_id, count(tok.w) AS n FROM d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n::BIGINT AS n_tokens, {_D("CASE WHEN n >= 12 THEN h ELSE 4 END")} AS entropy, {_D("CASE WHEN n >= 12 THEN least(500, pow(2, h)) ELSE 50 END")} AS perplexity,
  {_D("CASE WHEN n >= 12 THEN 1 - greatest(0, least(1, (pow(2, h) - 20) / 180)) ELSE 0.5 END")} AS predictability
FROM t LEFT JOIN h USING (doc_id)"""

ADJACENT = rf"""
WITH {BASE},
w AS (SELECT doc_id, no, list_distinct(regexp_extract_all(lower(s), '[a-z0-9_''-]+')) AS w FROM sent),
p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY no) AS u, no FROM w),
j AS (SELECT doc_id, CASE WHEN len(w) + len(u) > 0 THEN len(list_intersect(w, u)) / (len(w) + len(u) - len(list_intersect(w, u))) ELSE 0 END AS j FROM p WHERE no > 1),
n AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id),
a AS (SELECT doc_id, avg(j) AS m, var_pop(j) AS v, max(j) AS x FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, {_D("coalesce(m, 0)")} AS mean_similarity, {_D("coalesce(v, 0)")} AS var_similarity, {_D("coalesce(x, 0)")} AS max_similarity
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)"""

TOP_WORDS = rf"""
WITH {BASE}, c AS (SELECT doc_id, w, count(*) AS n, min(pos) AS f FROM tok GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f)::BIGINT AS rank, w AS word, n::BIGINT AS n FROM c QUALIFY rank <= 10"""

PHRASES = rf"""
WITH {_GRAM_BASE}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n * c DESC, g, c, n)::BIGINT AS rank, g AS phrase, n::BIGINT AS words, c::BIGINT AS n, (n * c)::BIGINT AS weight
FROM gc WHERE n >= 4 AND c > 1 QUALIFY rank <= 10"""

_ABBR1 = "(?i)(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|inc|ltd)[.]"
_V1 = rf"string_split_regex(regexp_replace(text, '{_ABBR1}', '\1' || chr(1), 'g'), '[.!?]+[{WS}]+')"
SEGMENTS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, {trimmed(f"regexp_replace(text, '[{WS}]+', ' ', 'g')")} AS flat FROM d)
SELECT doc_id, length(regexp_replace(text, '[{WS}]+', '', 'g'))::BIGINT AS letters,
  len(regexp_extract_all(lower(text), '[a-z0-9_''-]+'))::BIGINT AS tokens_web,
  len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: regexp_full_match(x, '[a-z]+')))::BIGINT AS tokens_letters,
  len(regexp_extract_all(lower(text), '[a-z''-]+'))::BIGINT AS tokens_v1, len(regexp_extract_all(lower(text), '\b[a-z''-]+\b'))::BIGINT AS tokens_ext,
  len(list_filter(string_split(regexp_replace(flat, '([.!?])[{WS}]+', '\1' || chr(2), 'g'), chr(2)), lambda s: length({trimmed("s")}) > 5))::BIGINT AS sentences_flat,
  len(list_filter(string_split_regex(text, '[.!?]+[{WS}]+'), lambda s: {trimmed("s")} <> ''))::BIGINT AS sentences_ext,
  len(list_filter({_V1}, lambda s: len(regexp_extract_all(s, '[^{WS}]+')) >= 2))::BIGINT AS sentences_v1,
  len(list_filter({_V1}, lambda s: len(regexp_extract_all(s, '[^{WS}]+')) >= 3))::BIGINT AS sentences_v1_long,
  len(list_filter(string_split_regex(text, '[.!?]+[{WS}]+|[.!?]+$'), lambda s: {trimmed("s")} <> ''))::BIGINT AS sentences_v2,
  len(list_filter(string_split(regexp_replace(regexp_replace(text, '[|]', chr(2), 'g'), '([.!?])[{WS}]+', '\1' || chr(2), 'g'), chr(2)), lambda s: length({trimmed("s")}) > 5))::BIGINT AS sentences_bench,
  len(list_filter(string_split_regex(text, '\n[{WS}]*\n'), lambda s: {trimmed("s")} <> ''))::BIGINT AS paragraphs
FROM f"""

_V1W = "regexp_extract_all(lower({0}), '[a-z''-]+')"
_SYL1 = """CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '[^aeiouy]le$') THEN 1 ELSE 0 END) END"""
_RATE = lambda sign: f"len(regexp_extract_all(text, '{sign}')) / s"
_FEATURES = {
    "sentence_count": "s", "avg_sentence_length": "am", "sentence_length_cv": "cv", "sentence_length_std": "sd", "sentence_length_min": "lo", "sentence_length_max": "hi", "sentence_length_range": "hi - lo",
    "sentence_length_skewness": "CASE WHEN m >= 3 AND sd > 0 THEN s3 / pow(sd, 3) * m / ((m - 1) * (m - 2)) ELSE 0 END", "sentence_length_kurtosis": "CASE WHEN m >= 4 AND sd > 0 THEN s4 / m / pow(sd, 4) - 3 ELSE 0 END",
    "word_count": "n", "unique_word_count": "v", "type_token_ratio": "v / n", "hapax_count": "v1", "hapax_ratio": "v1 / v", "dis_legomena_ratio": "v2 / v",
    "zipf_slope": "CASE WHEN v >= 5 THEN slope ELSE -1 END", "zipf_r_squared": "CASE WHEN v >= 5 AND syy * v > 1e-9 THEN r2 ELSE 0 END", "zipf_residual_std": "CASE WHEN v >= 5 THEN sqrt(greatest(0, syy - slope * slope * sxx) / v) ELSE 0 END",
    "burstiness_sentence": "CASE WHEN m >= 2 AND sd + am <> 0 THEN (sd - am) / (sd + am) ELSE 0 END", "burstiness_word_length": "(ks - km) / (ks + km)",
    "avg_word_length": "wm", "word_length_cv": "ws / wm", "syllable_ratio": "y / n", "flesch_kincaid_grade": "0.39 * n / s + 11.8 * y / n - 15.59",
    "automated_readability_index": f"4.71 * length(regexp_replace(text, '[{WS}]', '', 'g')) / n + 0.5 * n / s - 21.43",
    "bigram_repetition_rate": "g2", "trigram_repetition_rate": "g3", "sentence_similarity_avg": "coalesce(sim, 0)",
    "comma_rate": _RATE(","), "semicolon_rate": _RATE(";"), "question_rate": _RATE("[?]"), "exclamation_rate": _RATE("!"),
    "paragraph_count": "np", "avg_paragraph_length": "pm", "paragraph_length_cv": "CASE WHEN pm <> 0 THEN coalesce(ps, 0) / pm ELSE 0 END", "overall_uniformity": "1 - cv", "complexity_cv": "cv",
}
FEATURES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
se AS (
  SELECT doc_id, no, replace(s, chr(1), '.') AS s FROM (
    SELECT doc_id, unnest(range(1, len(ps) + 1)) AS no, unnest(ps) AS s FROM (SELECT doc_id, {_V1} AS ps FROM d))
  WHERE len(regexp_extract_all(s, '[^{WS}]+')) >= 2),
sl AS (SELECT doc_id, no, s, {_V1W.format("s")} AS ws, len({_V1W.format("s")})::DOUBLE AS x FROM se),
a AS (SELECT doc_id, x FROM sl WHERE x > 0),
ag AS (SELECT doc_id, count(*)::DOUBLE AS m, avg(x) AS am, coalesce(stddev_samp(x), 0) AS sd, min(x) AS lo, max(x) AS hi FROM a GROUP BY doc_id),
am4 AS (SELECT doc_id, sum(pow(x - am, 3)) AS s3, sum(pow(x - am, 4)) AS s4 FROM a JOIN ag USING (doc_id) GROUP BY doc_id),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS x, ws FROM (SELECT doc_id, {_V1W.format("text")} AS ws FROM d)),
cnt AS (SELECT doc_id, x, count(*) AS c FROM w GROUP BY ALL),
voc AS (SELECT doc_id, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, count(*) FILTER (c = 1) AS v1, count(*) FILTER (c = 2) AS v2 FROM cnt GROUP BY doc_id),
zipf AS (SELECT doc_id, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx FROM (SELECT doc_id, ln(row_number() OVER (PARTITION BY doc_id ORDER BY c DESC)) AS x, ln(c) AS y FROM cnt) GROUP BY doc_id),
wl AS (SELECT doc_id, avg(length(x)) AS wm, stddev_samp(length(x)) AS ws, avg(length(x)) FILTER (pos <= 100) AS km, stddev_samp(length(x)) FILTER (pos <= 100) AS ks, sum({_SYL1}) AS y FROM w GROUP BY doc_id),
g AS (
  SELECT doc_id, k, count(*) FILTER (c > 1) / count(*) AS r FROM (
    SELECT doc_id, k, array_to_string(ws[pos:pos + k - 1], ' ') AS z, count(*) AS c FROM w, (SELECT unnest([2, 3]) AS k) WHERE pos + k - 1 <= len(ws) GROUP BY ALL) GROUP BY doc_id, k),
gg AS (SELECT doc_id, max(r) FILTER (k = 2) AS g2, max(r) FILTER (k = 3) AS g3 FROM g GROUP BY doc_id),
pr AS (SELECT doc_id, list_distinct(ws) AS b, lag(list_distinct(ws)) OVER (PARTITION BY doc_id ORDER BY no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS r FROM sl),
si AS (SELECT doc_id, avg(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) AS sim FROM pr WHERE r > 1 AND len(a) + len(b) > 0 GROUP BY doc_id),
pa AS (SELECT doc_id, len({_V1W.format("p")})::DOUBLE AS x FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\n[{WS}]*\n'), lambda q: {trimmed("q")} <> '')) AS p FROM d)),
pg AS (SELECT doc_id, count(*) AS np, coalesce(avg(x) FILTER (x > 0), 1) AS pm, stddev_samp(x) FILTER (x > 0) AS ps FROM pa GROUP BY doc_id),
j AS (
  SELECT d.doc_id, text, (SELECT count(*) FROM se WHERE se.doc_id = d.doc_id)::DOUBLE AS s, * EXCLUDE (doc_id, text), CASE WHEN m >= 2 AND am <> 0 THEN sd / am ELSE 0 END AS cv
  FROM d LEFT JOIN ag USING (doc_id) LEFT JOIN am4 USING (doc_id) LEFT JOIN voc USING (doc_id) LEFT JOIN zipf USING (doc_id) LEFT JOIN wl USING (doc_id)
  LEFT JOIN gg USING (doc_id) LEFT JOIN si USING (doc_id) LEFT JOIN pg USING (doc_id))
SELECT doc_id, {", ".join(f"round((CASE WHEN n >= 10 AND s >= 2 THEN {v} ELSE 0 END)::DOUBLE + 1e-9, 6) AS {k}" for k, v in _FEATURES.items())}
FROM j"""

_COUNTS = "count(*) FILTER (said AND y = 1) AS tp, count(*) FILTER (said AND y = 0) AS fp, count(*) FILTER (NOT said AND y = 1) AS fn, count(*) FILTER (NOT said AND y = 0) AS tn, count(*) FILTER (sure) AS su, count(*) FILTER (sure AND said = (y = 1)) AS sr"
_PRED = f"WITH {SCORES}, pr AS (SELECT an.doc_id, p, quality AS y, p >= 0.5 AS said, p >= 0.8 OR p <= 0.2 AS sure, documents.lang, documents.source, CASE WHEN nw < 50 THEN 'short' WHEN nw < 200 THEN 'medium' ELSE 'long' END AS length FROM an JOIN labels USING (doc_id) JOIN documents USING (doc_id))"


def _q(a: str, b: str) -> str:
    return f"round((CASE WHEN {b} <> 0 THEN ({a}) / ({b}) ELSE 0 END)::DOUBLE + 1e-9, 6)"


_RATES = f"""tp, fp, fn, tn, {_q("tp + tn", "(tp + fp + fn + tn)")} AS accuracy, {_q("tp", "(tp + fp)")} AS precision, {_q("tp", "(tp + fn)")} AS recall, {_q("2 * tp", "(2 * tp + fp + fn)")} AS f1,
  {_q("fp", "(fp + tn)")} AS false_positive_rate, {_q("fn", "(fn + tp)")} AS false_negative_rate, {_q("su", "(tp + fp + fn + tn)")} AS sure_share, {_q("sr", "su")} AS sure_accuracy"""
METRICS_BY = f"""{_PRED}
SELECT breakdown, value, {_RATES} FROM (
  SELECT 'all' AS breakdown, NULL AS value, {_COUNTS} FROM pr UNION ALL
  SELECT 'lang', lang, {_COUNTS} FROM pr GROUP BY lang UNION ALL SELECT 'source', source, {_COUNTS} FROM pr GROUP BY source UNION ALL SELECT 'length', length, {_COUNTS} FROM pr GROUP BY length)"""
AUC = f"""{_PRED}
SELECT round((sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*))::DOUBLE + 1e-9, 6) AS auc, count(DISTINCT a.doc_id) AS n_positive, count(DISTINCT b.doc_id) AS n_negative
FROM (SELECT doc_id, round(p::DOUBLE, 9) AS p FROM pr WHERE y = 1) a, (SELECT doc_id, round(p::DOUBLE, 9) AS p FROM pr WHERE y = 0) b"""
_COMPARED = ("len_cv", "ttr", "hapax_per_type", "syllables_per_word")
_SQL_OF = {"len_cv": "cv", "ttr": "ttr", "hapax_per_type": "hpt", "syllables_per_word": "spw"}
COMPARE = f"""WITH {SCORES},
x AS (SELECT quality AS y, unnest([{", ".join(f"'{c}'" for c in _COMPARED)}]) AS feature, unnest([{", ".join(f"{_SQL_OF[c]}::DOUBLE" for c in _COMPARED)}]) AS v FROM f JOIN labels USING (doc_id)),
g AS (SELECT feature, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1, var_pop(v) FILTER (y = 0) AS v0, var_pop(v) FILTER (y = 1) AS v1, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM x GROUP BY feature),
t AS (SELECT *, (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t FROM g)
SELECT feature, {_D("m0")} AS mean_0, {_D("m1")} AS mean_1, n0 AS n_0, n1 AS n_1, {_D("(m0 - m1) / sqrt((v0 + v1) / 2)")} AS effect, {_D("t")} AS t,
  {_D("CASE WHEN abs(t) > 10 THEN 0.0001 WHEN abs(t) > 5 THEN 0.001 WHEN abs(t) > 3 THEN 0.01 WHEN abs(t) > 2 THEN 0.05 ELSE 0.1 END")} AS p_value FROM t"""

from inkstone.operators.formatting import HIDDEN, STYLE  # noqa: E402


def _n(p: str) -> str:
    return "len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))::BIGINT"


FORMATTING = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, stddev_pop(k) AS sd, avg(k) AS m, count(*) AS n FROM (SELECT doc_id, len(regexp_extract_all(x, ' ')) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)) GROUP BY doc_id),
c AS (SELECT doc_id, text, length(text)::BIGINT AS n_chars, {", ".join(f"{_n(p)} AS {k}" for k, p in {**STYLE, **{f"hidden_{k}": p for k, p in HIDDEN.items()}}.items())} FROM d)
SELECT doc_id, n_chars, n::BIGINT AS n_lines, {", ".join(STYLE)}, {", ".join(f"hidden_{k}" for k in HIDDEN)}, {" + ".join(f"hidden_{k}" for k in HIDDEN)} AS hidden, n_chars - ascii - extended AS unicode,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[ \\t]+$')))::BIGINT AS trailing_blanks, (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1 AS mixed_line_ends,
  {_D("CASE WHEN n > 1 THEN 1 - least(1, CASE WHEN m <> 0 THEN sd / m ELSE 0 END) ELSE 0.5 END")} AS line_uniformity,
  {_D("CASE WHEN one_space + two_spaces > 0 THEN greatest(one_space, two_spaces) / (one_space + two_spaces) ELSE 1 END")} AS spacing_uniformity,
  one_space + two_spaces > 0 AND (one_space = 0 OR two_spaces = 0) AS spacing_consistent
FROM c JOIN l USING (doc_id)"""

SAMPLE_REPORT = r"""
WITH s AS (SELECT text, quality AS label, source, len(regexp_extract_all(text, '\S+')) AS n FROM documents JOIN labels USING (doc_id) WHERE len(regexp_extract_all(text, '\S+')) >= 20)
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (label = 0) AS n_human, count(*) FILTER (label = 1) AS n_machine, round(avg(n)::DOUBLE + 1e-9, 6) AS mean_words, min(n)::BIGINT AS least_words, max(n)::BIGINT AS most_words FROM s GROUP BY source"""
BALANCED = """
WITH s AS (SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, md5('42-' || text) AS key FROM s)
SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key, doc_id) AS r FROM k) WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM s GROUP BY label))"""
PASTED = r"""
SELECT page_id, CASE WHEN contains(html, 'docs-internal-guid') OR contains(html, 'google-docs') THEN 'google-docs' WHEN contains(html, 'MsoNormal') OR contains(html, 'Microsoft') THEN 'microsoft-office' WHEN contains(html, 'notion') THEN 'notion' ELSE 'unknown' END AS pasted_from,
  array_to_string(list_filter([CASE WHEN contains(html, '&nbsp;') THEN 'non-breaking-spaces' END, CASE WHEN regexp_matches(html, '(?i)style\s*=\s*["''][^"'']*font') THEN 'inline-font-styles' END,
    CASE WHEN contains(html, '<!--') THEN 'html-comments' END, CASE WHEN regexp_matches(html, '[\x{200B}\x{200C}\x{200D}\x{FEFF}]') THEN 'zero-width-characters' END], lambda x: x IS NOT NULL), ',') AS hidden
FROM pages"""
TURNS = r"""
SELECT role, count(*)::BIGINT AS n_turns, count(DISTINCT conv_id)::BIGINT AS n_conversations, sum(len(regexp_extract_all(lower(text), '[a-z0-9_''-]+')))::BIGINT AS n_tokens FROM conversations GROUP BY role"""
NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v) GROUP BY label, i) GROUP BY label)
SELECT v.vec_id, round(list_cosine_similarity(e, c) + 1e-9, 6) AS similarity FROM v JOIN c USING (label)"""

#: The fitted share of bin i: the greatest over j <= i of the least mean over bins j to k >= i.
CALIBRATION = f"""{_PRED},
bn AS (SELECT least(49, floor(p * 50))::INT AS bin, count(*) AS n, sum(y)::BIGINT AS positive, avg(p) AS centre FROM (SELECT round(p::DOUBLE, 9) AS p, y FROM pr) GROUP BY 1),
mm AS (SELECT j.bin AS j, k.bin AS k, (SELECT sum(positive) / sum(n) FROM bn WHERE bin BETWEEN j.bin AND k.bin) AS m FROM bn j JOIN bn k ON j.bin <= k.bin),
ff AS (SELECT i, max(m) AS fitted FROM (SELECT b.bin AS i, j, min(m) AS m FROM bn b JOIN mm ON j <= b.bin AND k >= b.bin GROUP BY b.bin, j) GROUP BY i)
SELECT bin, n, positive, round(centre::DOUBLE + 1e-9, 6) AS centre, round((positive / n)::DOUBLE + 1e-9, 6) AS observed, round(fitted::DOUBLE + 1e-9, 6) AS calibrated FROM bn JOIN ff ON i = bin"""
