"""Signals that a text was rewritten to look natural: 36 features, a probability, a
verdict and flags for each document.

Twelve families of features look at windows that depend on the text's length,
half-overlapping windows, correlations of paired series, and counts. All of it
is within the row; steps that later ones use several times are columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import segment
from inkstone.functions import signal_lists as L
from inkstone.functions.arrays import lit
from inkstone.functions.series import exact_std, pair_ends, words_of_pairs
from inkstone.operators.categories import _contained

FAMILIES = {
    "variance": ("variance_of_variance", "variance_stability", "local_variance_consistency"),
    "autocorrelation": ("autocorr_decay_rate", "autocorr_flatness", "autocorr_periodicity"),
    "correlation": ("length_complexity_corr", "vocab_structure_corr", "feature_correlation_breaks"),
    "synonyms": ("synonym_cluster_usage", "rare_synonym_ratio", "sophistication_jumps"),
    "contractions": ("contraction_rate", "contraction_uniformity", "artificial_contraction_score"),
    "structure": ("sentence_start_diversity", "structure_template_score", "parallelism_score"),
    "sophistication": ("sophistication_variance", "sophistication_autocorr", "word_choice_consistency"),
    "ngrams": ("bigram_predictability", "trigram_predictability", "ngram_surprise_variance"),
    "punctuation": ("comma_density", "punctuation_variety", "punctuation_position_entropy"),
    "discourse": ("transition_density", "hedging_density", "discourse_marker_variety"),
    "word_lengths": ("word_length_variance", "word_length_entropy", "long_word_clustering"),
    "entropy": ("lexical_entropy", "sentence_entropy", "entropy_stability"),
}
FEATURES = [name for names in FAMILIES.values() for name in names]


def positions(last: Column, step: int = 1) -> Column:
    """0, step, 2 * step, ... up to ``last``; empty if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def exact_var(window: Column) -> Column:
    """Population variance of a window of whole numbers, from exact sums."""
    zero = F.struct(*[A.zero().alias(k) for k in "nsq"])
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x.cast("double") * x).alias("q"))
    return F.aggregate(window, zero, step, lambda a: F.when(a["n"] > 0, (a["n"] * a["q"] - a["s"] * a["s"]) / (a["n"] * a["n"])).otherwise(lit(0)))


def pearson(pairs: Column) -> Column:
    """Correlation of structs x, y; 0 where their spreads' product is hardly anything."""
    names = ("n", "x", "y", "xy", "xx", "yy")
    step = lambda a, p: F.struct(
        (a["n"] + 1).alias("n"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"),
        (a["xy"] + p["x"] * p["y"]).alias("xy"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["yy"] + p["y"] * p["y"]).alias("yy"),
    )

    def done(a: Column) -> Column:
        n = F.greatest(a["n"], lit(1))
        below = F.sqrt(F.greatest(lit(0), (a["xx"] - a["x"] * a["x"] / n) * (a["yy"] - a["y"] * a["y"] / n)))
        return F.when((n >= 2) & (below > 0.0001), (a["xy"] - a["x"] * a["y"] / n) / below).otherwise(lit(0))

    return F.aggregate(pairs, F.struct(*[A.zero().alias(k) for k in names]), step, done)


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def surprise_variance(pairs: Column, ends: Column, first: Column) -> Column:
    """Variance of -ln(p + 0.01) over all pairs of neighbours but the first, p the
    pair's share of what follows its first word in this text. One pass over the
    sorted pairs, whose first words' counts are the lengths of their runs."""
    zero = F.struct(*[A.zero().alias(k) for k in ("c", "n", "s", "q")], F.lit(0).alias("i"))

    def of_word(acc: Column, r: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            c = acc["c"] + 1
            weight = c - F.when(F.get(pairs, acc["i"]) == first, 1).otherwise(0)
            more = lambda y: F.struct(A.zero().alias("c"), (acc["n"] + weight).alias("n"), (acc["s"] + weight * y).alias("s"), (acc["q"] + weight * y * y).alias("q"), (acc["i"] + 1).alias("i"))
            same = F.struct(c.alias("c"), acc["n"].alias("n"), acc["s"].alias("s"), acc["q"].alias("q"), (acc["i"] + 1).alias("i"))
            return F.when(e == 0, same).otherwise(A.let(-F.log(c / (r["b"] - r["a"]) + 0.01), more))

        return F.aggregate(F.slice(ends, r["a"] + 1, r["b"] - r["a"]), acc, step)

    return F.aggregate(words_of_pairs(ends), zero, of_word, lambda a: F.when(a["n"] > 0, F.greatest(lit(0), a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]))).otherwise(lit(0)))


def nats(counts: Column, n: Column) -> Column:
    return A.entropy_bits(counts, n) * math.log(2)


def rewriting_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, 36 features, ``probability``, ``verdict`` and ``flags`` (by commas).

    A text of fewer than 100 characters, 30 words or 3 sentences has no features,
    the probability 0.5 and no verdict. In the probability a feature of 0
    counts as 0.5, as one that can't be measured does.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.lower("text").alias("low"), segment.tokens_letters(F.col("text")).alias("w"), segment.sentences_flat(F.col("text")).alias("s"))
    long = F.length("text") + F.regexp_count("text", F.lit(r"[\x{10000}-\x{10FFFF}]")) >= 100
    d = d.withColumn("ok", long & (F.size("s") >= 3) & (F.size("w") >= 30))
    d = d.withColumns({"w": F.when(F.col("ok"), F.col("w")).otherwise(F.array().cast("array<string>")), "s": F.when(F.col("ok"), F.col("s")).otherwise(F.array().cast("array<string>"))})
    space = f"[{segment.SPACE}]+"
    contraction = F.lit("[a-z0-9_]+'[a-z0-9_]+")

    def quarters(s: Column) -> Column:
        place = lambda words: F.transform(words, lambda x, i: F.when(F.contains(x, F.lit(",")), F.floor(F.least(lit(3), i * 4 / F.size(words)))))
        return F.when(F.contains(s, F.lit(",")), F.filter(A.let(F.split(s, space), place), lambda x: x.isNotNull())).otherwise(F.array().cast("array<bigint>"))

    d = d.withColumns(
        {
            "sw": F.transform("s", segment.tokens_letters), "kw": F.transform("w", F.length), "n": F.size("s"), "nw": F.size("w"),
            "p2": F.sort_array(A.ngrams(F.col("w"), 2)), "g3": A.ngrams(F.col("w"), 3), "cs": F.transform("s", lambda x: F.when(F.contains(x, F.lit("'")), F.regexp_count(F.lower(x), contraction)).otherwise(0)),
            "commas_at": F.flatten(F.transform("s", quarters)),
        }
    )
    d = d.withColumn("p1", F.transform("p2", lambda x: F.substring_index(x, " ", 1)))
    fives, tens = positions(F.col("nw") - 6, 5), positions(F.col("nw") - 11, 10)
    d = d.withColumns(
        {
            "k": F.transform("sw", F.size), "letters": F.transform("sw", lambda x: F.aggregate(x, F.lit(0), lambda a, t: a + F.length(t))),
            "sig": F.transform("sw", lambda x: F.array_join(F.transform(F.slice(x, 1, 3), lambda t: F.substring(t, 1, 1)), "_")), "firsts": F.filter(F.transform("sw", lambda x: F.get(x, 0)), lambda x: x.isNotNull()),
            "fives": F.transform(fives, lambda i: F.aggregate(F.slice("kw", i + 1, 5), F.lit(0), lambda a, x: a + x)), "tens": F.transform(tens, lambda i: F.size(F.array_distinct(F.slice("w", i + 1, 10)))),
            "far": F.filter(F.transform("kw", lambda x, i: F.when(x >= 8, i)), lambda i: i.isNotNull()),
            "halves": F.transform(positions(F.col("nw") - 21, 10), lambda i: A.let(F.slice("w", i + 1, 20), _window_nats)), "ends": pair_ends(F.col("p2"), F.col("p1")),
        }
    )
    d = A.with_run_counts(d, c3="g3", cw="w", ck="k", ckw="kw", csig="sig", bins="commas_at")
    width = F.greatest(F.lit(3), F.floor(F.col("n") / 4).cast("int"))
    chunks = F.transform(positions(F.col("n") - 3), lambda i: F.struct(F.flatten(F.slice("sw", i + 1, 3)).alias("w"), F.slice("k", i + 1, 3).alias("k")))
    d = d.withColumns({"sums": A.running(F.col("k")), "squares": A.running(F.transform("k", lambda x: x.cast("double") * x))})
    d = d.withColumns(
        {
            "m": A.mean(F.col("k")), "v": exact_var(F.col("k")), "mk": exact_var(F.col("kw")), "gaps": A.lagged_pairs(F.col("far"), lambda x, y: y - x),
            "local": F.transform(positions(F.col("n") - width), lambda i: _window_var(i, width)),
            "chunks": F.filter(F.transform(chunks, lambda c: F.when(F.size(c["w"]) > 0, _xy(F.size(F.array_distinct(c["w"])) / F.size(c["w"]), F.sqrt(exact_var(c["k"])) / (F.size(c["w"]) / 3 + 0.1)))), lambda x: x.isNotNull()),
            "complex": F.filter(F.transform("sw", lambda x: F.when(F.size(x) > 0, _xy(F.size(x), F.size(F.filter(x, lambda t: F.length(t) > 6)) / F.size(x)))), lambda x: x.isNotNull()),
            "soph": F.filter(F.zip_with("letters", "k", lambda x, k: F.when(k > 0, x / k)), lambda x: x.isNotNull()),
        }
    )
    n, nw, m, v = F.col("n"), F.col("nw").cast("double"), F.col("m"), F.col("v")
    lags = [F.when((v >= 0.01) & (F.lit(j) <= F.least(F.lit(5), F.floor(n / 2))), A.total(A.lagged_pairs(F.col("k"), lambda x, y: (x - m) * (y - m), j)) / (n - j) / v) for j in range(1, 6)]
    d = d.withColumns(
        {
            "ac": F.filter(F.array(*lags), lambda x: x.isNotNull()), "lm": A.mean(F.col("local")), "ls": A.std_pop(F.col("local")), "cm": A.mean(F.col("cs")), "tw": F.regexp_count("text", F.lit("[A-Za-z0-9_]+")).cast("double"),
            "plain": F.size(F.filter("w", lambda t: t.isin(*L.FINER_WORDS))), "fine": _fine_words(F.col("w")),
            "corr": pearson(F.col("complex")), "transition": _contained(F.col("low"), L.TRANSITION_MARKERS), "hedging": _contained(F.col("low"), L.HEDGING_PHRASES),
        }
    )
    ac, few = F.col("ac"), n < 5
    flat = v < 0.01
    half = lit(0.5)
    one = lambda x: F.least(lit(1), x)
    k_ac = F.size(ac).cast("double")
    cluster = (F.col("plain") + F.col("fine")).cast("double")
    rate = one(A.ratio(F.regexp_count("low", contraction) * lit(20), F.col("tw")))
    uniform = F.when((F.regexp_count("low", contraction) >= 2) & (F.col("cm") > 0), 1 - one(exact_std(F.col("cs")) / (F.col("cm") + 0.1))).otherwise(half)
    stability = 1 - one(F.col("ls") / (F.col("lm") + 0.1))
    # most of a text goes in runs first
    marks = F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", r"[A-Za-z0-9_ \n]+", ""), F.lit(f"[^A-Za-z0-9_{segment.SPACE}]"), 0))
    repeated = lambda c: F.size(F.filter(c, lambda x: x > 1)).cast("double")
    soph = F.col("soph")
    d = d.withColumns({"contraction_rate": rate, "contraction_uniformity": uniform, "length_complexity_corr": F.when(~few & (F.size("complex") >= 5), (F.col("corr") + 1) / 2).otherwise(half)})
    lcc = F.round(F.col("length_complexity_corr"), 9)
    features = {
        "variance_of_variance": one(F.pow(F.col("ls"), lit(2)) / (v + 1)), "variance_stability": stability, "local_variance_consistency": F.when(F.size("local") > 2, stability).otherwise(half),
        "autocorr_decay_rate": F.when(few | flat, half).otherwise(F.greatest(lit(0), one((F.get(ac, 0) - F.element_at(ac, -1)) / k_ac + 0.5))),
        "autocorr_flatness": F.when(few, half).when(flat, lit(1)).otherwise(1 - one(A.var_pop(ac) * 10)),
        "autocorr_periodicity": F.when(few, half).when(flat | (F.size(ac) < 3), lit(0)).otherwise(A.total(A.lagged_pairs(ac, lambda x, y: (x * y < 0).cast("int"))) / (k_ac - 1)),
        "length_complexity_corr": F.col("length_complexity_corr"), "vocab_structure_corr": F.when(~few & (F.size("chunks") >= 3), (pearson(F.col("chunks")) + 1) / 2).otherwise(half),
        "feature_correlation_breaks": F.when(few, half).otherwise(F.abs(F.when(lcc == 0, half).otherwise(lcc) - 0.8)),
        "synonym_cluster_usage": cluster / nw, "rare_synonym_ratio": A.ratio(F.col("fine").cast("double"), cluster),
        "sophistication_jumps": F.when(F.size("fives") > 2, A.mean(A.lagged_pairs(F.col("fives"), lambda x, y: F.abs(y - x))) / 15).otherwise(lit(0)),
        "contraction_rate": F.col("contraction_rate"), "contraction_uniformity": F.col("contraction_uniformity"),
        "artificial_contraction_score": F.when((F.round("contraction_rate", 9) > 0.3) & (F.round("contraction_uniformity", 9) > 0.7), (F.col("contraction_rate") + F.col("contraction_uniformity")) / 2).otherwise(lit(0)),
        "sentence_start_diversity": A.ratio(A.size(F.array_distinct("firsts")), A.size(F.col("firsts")), 0.5), "structure_template_score": repeated("csig") / n,
        "parallelism_score": A.total(A.lagged_pairs(F.col("k"), lambda x, y: (F.abs(x - y) <= 2).cast("int"))) / (n - 1),
        "sophistication_variance": F.when(F.size(soph) >= 3, one(A.var_pop(soph) / 4)).otherwise(half), "sophistication_autocorr": F.when(F.size(soph) >= 4, (pearson(A.lagged_pairs(soph, _xy)) + 1) / 2).otherwise(half),
        "word_choice_consistency": F.when(F.size("tens") > 2, 1 - one(exact_std(F.col("tens")) / 2)).otherwise(half),
        "bigram_predictability": A.total(A.lagged_pairs(F.col("ends"), lambda x, y: ((x == 0) & (y > 0)).cast("int"))) / (nw - 1), "trigram_predictability": repeated("c3") / (nw - 2), "ngram_surprise_variance": one(surprise_variance(F.col("p2"), F.col("ends"), F.concat(F.get("w", 0), F.lit(" "), F.get("w", 1))) / 2),
        "comma_density": one(F.regexp_count("text", F.lit(",")) / (F.col("tw") / 10)), "punctuation_variety": one(F.size(marks) / lit(8)),
        "punctuation_position_entropy": F.when(F.size("commas_at") >= 3, one(nats(F.col("bins"), A.size(F.col("commas_at"))) / 1.4)).otherwise(half),
        "transition_density": one(F.col("transition") / (n / 3 + 0.1)), "hedging_density": one(F.col("hedging") / (n / 5 + 0.1)), "discourse_marker_variety": F.when(F.col("transition") > 0, lit(1)).otherwise(half),
        "word_length_variance": one(F.col("mk") / 10), "word_length_entropy": one(nats(F.col("ckw"), nw) / 3), "long_word_clustering": F.when(F.size("far") >= 2, 1 - one(exact_var(F.col("gaps")) / 50)).otherwise(half),
        "lexical_entropy": nats(F.col("cw"), nw) / F.log(F.size("cw") + lit(1)), "sentence_entropy": nats(F.col("ck"), n.cast("double")) / F.log(F.size("ck") + lit(1)),
        "entropy_stability": F.when(F.size("halves") > 2, 1 - one(A.std_pop(F.col("halves")) * 2)).otherwise(half),
    }
    d = A.fenced(d.select("doc_id", "ok", *[F.when(F.col("ok"), F.round(features[name], 9)).alias(name) for name in FEATURES]))
    seen = lambda name: F.when(F.col(name) == 0, half).otherwise(F.col(name))
    score = sum((seen(k) * w if w > 0 else (1 - seen(k)) * -w for k, w in L.SIGNAL_WEIGHTS.items()), lit(0))
    d = A.fenced(d.withColumn("probability", F.when(F.col("ok"), F.round(score / sum(map(abs, L.SIGNAL_WEIGHTS.values())), 9)).otherwise(half)))
    verdict = F.when(~F.col("ok"), L.NO_VERDICT)
    for least, name in L.SIGNAL_VERDICTS:
        verdict = verdict.when(F.col("probability") >= least, name)
    flags = F.filter(F.array(*[F.when(F.col(name) > least, F.lit(flag)) for flag, name, least in L.SIGNAL_FLAGS]), lambda x: x.isNotNull())
    return d.select("doc_id", *FEATURES, "probability", verdict.otherwise(L.LAST_VERDICT).alias("verdict"), F.array_join(flags, ",").alias("flags"))


def _window_nats(window: Column) -> Column:
    n = A.size(window)
    return -A.total(F.transform(window, lambda t: F.log(A.times_in(window, t) / n))) / n


def _window_var(i: Column, width: Column) -> Column:
    """``exact_var`` of so many values of ``k`` from place i on, from the running sums."""
    between = lambda c: F.get(F.col(c), i + width) - F.get(F.col(c), i)
    return A.let(between("sums"), lambda s: (width * between("squares") - s * s) / (width.cast("double") * width))


def _fine_words(w: Column) -> Column:
    """Occurrences of finer words, of one that stands for two plain words twice."""
    every = [x for words in L.FINER_WORDS.values() for x in words]
    twice = sorted({x for x in every if every.count(x) > 1})
    return F.size(F.filter(w, lambda t: t.isin(*every))) + F.size(F.filter(w, lambda t: t.isin(*twice)))
