"""The six-category authorship analysis of every document of a corpus.

Sentence structure, vocabulary richness, Zipf's law, burstiness, repetition and
readability each give a probability and a confidence; their weighted mean is the
document's probability. All of it is expressions over one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import scoring as S
from inkstone.functions import segment
from inkstone.functions.arrays import lit

#: Name, number and weight of each category (fixed values).
CATEGORIES = {
    "syntax": ("Sentence Structure", 2, 0.22),
    "vocabulary": ("Vocabulary Richness", 3, 0.18),
    "zipf": ("Zipf's Law Analysis", 8, 0.12),
    "burstiness": ("Burstiness Patterns", 9, 0.18),
    "repetition": ("Repetition Patterns", 12, 0.15),
    "readability": ("Readability Analysis", 7, 0.15),
}
TOP_RANKS = 100


def segmented(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``tokens``, ``sentences`` and ``n_paragraphs``; a null text is like an empty one."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.select(
        "doc_id",
        "text",
        segment.tokens_web(F.col("text")).alias("tokens"),
        F.when(segment.trim(F.col("text")) == "", F.array().cast("array<string>")).otherwise(segment.sentences_web(F.col("text"))).alias("sentences"),
        F.size(segment.paragraphs(F.col("text"))).alias("n_paragraphs"),
    )


def _slope(freqs: Column) -> Column:
    """Of ln(frequency) over ln(rank); null for fewer than two ranks."""
    points = F.transform(freqs, lambda c, i: F.struct(F.log(i + lit(1)).alias("x"), F.log(c.cast("double")).alias("y")))
    zero = F.struct(*[A.zero().alias(k) for k in ("n", "x", "y", "xy", "xx")])

    def step(a, p):
        return F.struct(
            (a["n"] + 1).alias("n"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"),
            (a["xy"] + p["x"] * p["y"]).alias("xy"), (a["xx"] + p["x"] * p["x"]).alias("xx"),
        )

    def done(a):
        below = a["n"] * a["xx"] - a["x"] * a["x"]
        return F.when(below != 0, (a["n"] * a["xy"] - a["x"] * a["y"]) / below)

    return F.aggregate(points, zero, step, done)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of each document that the categories rest on."""
    s = segmented(docs, id_col, text_col)
    s = s.withColumns(
        {
            "lengths": F.transform("sentences", segment.words_by_space),
            "pair": A.ngrams(F.col("tokens"), 2),
            "triple": A.ngrams(F.col("tokens"), 3),
            "start": F.transform("sentences", lambda x: F.lower(F.regexp_extract(x, f"^[^{segment.SPACE}]+(?:[{segment.SPACE}]+[^{segment.SPACE}]+)?", 0))),
            "syllables": F.aggregate(F.transform("tokens", segment.syllables), F.lit(0), lambda a, x: a + x),
        }
    )
    s = s.withColumn("start", F.transform("start", lambda x: F.regexp_replace(x, f"[{segment.SPACE}]+", " ")))
    s = A.with_run_counts(s, counts="tokens", pairs="pair", triples="triple", starts="start")
    n, lengths = F.size("tokens"), F.col("lengths")
    hapax = F.size(F.filter("counts", lambda c: c == 1))
    astral = F.regexp_count("text", F.lit(r"[\x{10000}-\x{10FFFF}]"))
    s = s.select(
        "doc_id", "lengths", "tokens", (segment.trim(F.col("text")) == "").alias("blank"),
        (F.length("text") + astral).alias("characters"), n.alias("words"), F.size("sentences").alias("n_sentences"), "n_paragraphs",
        A.mean(lengths).alias("len_mean"), A.std_pop(lengths).alias("len_std"), A.cv(lengths).alias("len_cv"), A.percentile(lengths, 50).alias("len_median"),
        F.size("counts").alias("types"), hapax.alias("hapax"),
        _slope(F.slice(F.sort_array("counts", asc=False), 1, TOP_RANKS)).alias("slope"),
        F.size(F.filter("pairs", lambda c: c >= 3)).alias("repeated_pairs"), F.size(F.filter("triples", lambda c: c >= 2)).alias("repeated_triples"),
        F.coalesce(F.array_max("starts"), F.lit(0)).alias("top_start"), "syllables",
        A.window_variances(lengths, 5).alias("local"),
    )
    mean, std = F.col("len_mean"), F.col("len_std")
    return s.select(
        "*",
        F.when(F.col("n_sentences") >= 2, A.ratio(std - mean, std + mean)).otherwise(lit(0)).alias("len_burst"),
        F.when(F.col("n_sentences") >= 2, 1 - F.least(lit(1), F.col("len_cv") / lit(0.8))).otherwise(lit(0.5)).alias("len_uniformity"),
        A.ratio(F.col("types"), F.col("words")).alias("ttr"),
        A.ratio(F.col("hapax"), F.col("types")).alias("hapax_per_type"),
        A.ratio(F.col("top_start"), F.col("n_sentences")).alias("start_share"),
        A.ratio(F.col("syllables"), F.col("words")).alias("syllables_per_word"),
        (F.col("words") / F.greatest(lit(1), F.col("n_sentences"))).alias("words_per_sentence"),
        A.var_pop(F.col("local")).alias("local_var"), A.mean(F.col("local")).alias("local_mean"), F.size("local").alias("n_local"),
    )


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measured`` with a probability ``p_*`` and confidence ``c_*`` of each category."""
    m = measured(docs, id_col, text_col)
    ns, nw = F.col("n_sentences"), F.col("words")

    def unlike(x: str, baseline: str) -> Column:
        return 1 - S.human_likelihood(F.col(x), S.BASELINES[baseline])

    def given(ok: Column, p: Column, otherwise: float) -> Column:
        return F.when(ok, p).otherwise(lit(otherwise))

    rep = F.when(F.col("repeated_triples") > 5, lit(0.3)).otherwise(lit(0)) + F.when((F.col("start_share") > 0.3) & (ns >= 5), lit(0.2)).otherwise(lit(0))
    return m.select(
        "*",
        given(ns >= 3, unlike("len_cv", "sentence_length_cv"), 0.5).alias("p_syntax"),
        given(ns >= 3, F.least(lit(0.9), lit(0.5) + ns / lit(50)), 0.3).alias("c_syntax"),
        given(nw >= 20, unlike("hapax_per_type", "hapax_ratio"), 0.5).alias("p_vocabulary"),
        given(nw >= 20, F.least(lit(0.85), lit(0.4) + nw / lit(500)), 0.3).alias("c_vocabulary"),
        given((nw >= 50) & F.col("slope").isNotNull(), unlike("slope", "zipf_slope"), 0.5).alias("p_zipf"),
        given(nw >= 50, lit(0.7), 0.3).alias("c_zipf"),
        given(ns >= 5, unlike("len_burst", "burstiness"), 0.5).alias("p_burstiness"),
        given(ns >= 5, lit(0.65), 0.3).alias("c_burstiness"),
        F.least(lit(0.9), rep + lit(0.3)).alias("p_repetition"),
        lit(0.6).alias("c_repetition"),
        (F.col("len_uniformity") * 0.7 + 0.15).alias("p_readability"),
        lit(0.55).alias("c_readability"),
    )


def analyze(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: probability, confidence, interval, verdict and statistics.

    A null or blank text has probability 0, confidence 0 and the verdict
    ``Unknown``. A text of a single word type has no slope; its Zipf category is
    a half.
    """
    s = scored(docs, id_col, text_col)
    weights = {k: w for k, (_, _, w) in CATEGORIES.items()}
    top = sum(F.col(f"p_{k}") * lit(w) * F.col(f"c_{k}") for k, w in weights.items())
    below = sum(lit(w) * F.col(f"c_{k}") for k, w in weights.items())
    sure = sum(F.col(f"c_{k}") for k in weights) / lit(len(weights)) + F.least(lit(0.2), F.col("n_sentences") / lit(100))
    s = s.withColumn("p", F.when(F.col("blank"), lit(0)).otherwise(top / below)).withColumn("c", F.when(F.col("blank"), lit(0)).otherwise(F.least(lit(0.95), sure)))
    low, high = S.wilson(F.col("p"), F.col("n_sentences"))
    stable = (F.col("n_local") >= 3) & (F.col("len_cv") > 0.6) & (F.col("local_mean") > 0) & (F.col("local_var") < 0.3 * F.col("local_mean"))
    broken = F.abs(F.col("p_vocabulary") - F.col("p_syntax")) > 0.4
    blank = F.col("blank")
    out = s.select(
        "doc_id", F.col("p").alias("ai_probability"), (1 - F.col("p")).alias("human_probability"), F.col("c").alias("confidence"),
        F.when(~blank, low).alias("ci_lower"), F.when(~blank, high).alias("ci_upper"),
        F.when(blank, "Unknown").otherwise(S.verdict_label(F.col("p"))).alias("verdict"),
        F.when(~blank, S.verdict_confidence(F.col("p"))).alias("verdict_confidence"),
        *[F.col(c).cast("long").alias(c) for c in ("characters", "words", "n_sentences", "n_paragraphs", "types", "hapax", "repeated_pairs", "repeated_triples")],
        "len_mean", "len_median", "len_std", "len_cv", "len_burst", "len_uniformity", "ttr", "hapax_per_type", "slope", "syllables_per_word",
        (lit(0.39) * F.col("words_per_sentence") + lit(11.8) * F.col("syllables_per_word") - lit(15.59)).alias("grade_level"),
        (lit(206.835) - lit(1.015) * F.col("words_per_sentence") - lit(84.6) * F.col("syllables_per_word")).alias("reading_ease"),
        (stable & ~blank).alias("stable_variance"), (broken & ~blank).alias("broken_correlation"), (stable & broken & ~blank).alias("likely_humanized"),
    )
    return A.fenced(out)


def category_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and category; blank documents have none."""
    s = scored(docs, id_col, text_col).filter(~F.col("blank"))
    rows = [F.struct(F.lit(name).alias("name"), F.lit(number).alias("category"), F.col(f"p_{k}").alias("ai_probability"), F.col(f"c_{k}").alias("confidence")) for k, (name, number, _) in CATEGORIES.items()]
    return s.select("doc_id", F.inline(F.array(*rows)))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``category``, ``indicator`` and ``text`` of all that stands out, a row each."""
    s = scored(docs, id_col, text_col).filter(~F.col("blank"))
    B, ns, nw = S.BASELINES, F.col("n_sentences"), F.col("words")

    def number(x: Column, digits: int, unit: str = "") -> Column:
        return F.concat(F.format_string(f"%.{digits}f", F.round(x, digits) + lit(0)), F.lit(unit))

    def note(when: Column, category: int, indicator: str, text) -> Column:
        return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(indicator).alias("indicator"), (text if isinstance(text, Column) else F.lit(text)).alias("text")))

    def around(ok: Column, category: int, x: str, b, low, high, usual) -> list[Column]:
        v = F.col(x)
        return [note(ok & (v < b.low), category, *low), note(ok & (v > b.high), category, *high), note(ok & v.between(b.low, b.high), category, *usual)]

    cv, hapax, slope, burst = number(F.col("len_cv"), 3), number(F.col("hapax_per_type") * 100, 1, "%"), number(F.col("slope"), 2), number(F.col("len_burst"), 3)
    grade = lit(0.39) * F.col("words_per_sentence") + lit(11.8) * F.col("syllables_per_word") - lit(15.59)
    readable, ttr = F.col("len_cv"), F.col("ttr")
    rep, starts = F.col("repeated_triples") > 5, (F.col("start_share") > 0.3) & (ns >= 5)
    zipf = (nw >= 50) & F.col("slope").isNotNull()
    notes = [
        note(ns < 3, 2, "neutral", "too few sentences"),
        *around(ns >= 3, 2, "len_cv", B["sentence_length_cv"], ("ai", F.concat(F.lit("sentence lengths too even, cv "), cv)), ("mixed", F.concat(F.lit("sentence lengths too uneven, cv "), cv)), ("human", F.concat(F.lit("natural sentence lengths, cv "), cv))),
        note((ns >= 3) & (F.col("len_uniformity") > 0.7), 2, "ai", F.concat(F.lit("uniformity "), number(F.col("len_uniformity") * 100, 0, "%"))),
        note(nw < 20, 3, "neutral", "too few words"),
        *around(nw >= 20, 3, "hapax_per_type", B["hapax_ratio"], ("ai", F.concat(F.lit("few words used once, "), hapax)), ("mixed", F.concat(F.lit("very many words used once, "), hapax)), ("human", F.concat(F.lit("natural share of words used once, "), hapax))),
        note((nw >= 20) & (ttr < 0.25), 3, "ai", F.concat(F.lit("little variety of words, "), number(ttr, 3))),
        note((nw >= 20) & (ttr > 0.60), 3, "mixed", F.concat(F.lit("unusual variety of words, "), number(ttr, 3))),
        note(nw < 50, 8, "neutral", "too few words"),
        note(zipf & (F.col("slope") > -0.7), 8, "ai", F.concat(F.lit("word frequencies too flat, slope "), slope)),
        note(zipf & (F.col("slope") < -1.3), 8, "mixed", F.concat(F.lit("word frequencies too steep, slope "), slope)),
        note(zipf & F.col("slope").between(-1.3, -0.7), 8, "human", F.concat(F.lit("natural word frequencies, slope "), slope)),
        note(ns < 5, 9, "neutral", "too few sentences"),
        *around(ns >= 5, 9, "len_burst", B["burstiness"], ("ai", F.concat(F.lit("periodic sentence lengths, "), burst)), ("mixed", F.concat(F.lit("chaotic sentence lengths, "), burst)), ("human", F.concat(F.lit("natural bursts, "), burst))),
        note(rep, 12, "ai", F.concat(F.col("repeated_triples").cast("string"), F.lit(" repeated phrases of three words"))),
        note(starts, 12, "ai", F.concat(number(F.col("start_share") * 100, 0, "%"), F.lit(" of sentences start alike"))),
        note(~rep & ~starts, 12, "human", "natural variety of phrases"),
        note(readable < 0.25, 7, "ai", F.concat(F.lit("very even complexity, cv "), number(readable, 2))),
        note(readable > 1.0, 7, "mixed", F.concat(F.lit("very uneven complexity, cv "), number(readable, 2))),
        note(readable.between(0.25, 1.0), 7, "human", F.concat(F.lit("natural complexity, cv "), number(readable, 2))),
        note(grade.between(8, 14), 7, "human", F.concat(F.lit("grade "), number(grade, 1))),
    ]
    return s.select("doc_id", F.inline(F.array_compact(F.array(*notes))))
