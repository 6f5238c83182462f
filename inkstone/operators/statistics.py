"""Vocabulary, sequence and n-gram statistics of each document, all within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import scoring
from inkstone.functions import segment
from inkstone.functions import series as S
from inkstone.functions.arrays import lit
from inkstone.operators.authorship import segmented


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Richness of each document's words. Statistics without enough words are 0,
    except that the rank fit below 20 words has slope 0 and compliance 0.5."""
    s = segmented(docs, id_col, text_col).select("doc_id", "tokens")
    s = A.with_run_counts(s, counts="tokens")
    seg = F.when(F.size("tokens") >= 50, F.sequence(F.lit(0), F.expr("size(tokens) div 50 - 1"))).otherwise(F.array().cast("array<int>"))
    s = s.select(
        "doc_id", F.size("tokens").cast("double").alias("n"), F.size("counts").cast("double").alias("v"),
        F.size(F.filter("counts", lambda c: c == 1)).cast("double").alias("v1"), F.size(F.filter("counts", lambda c: c == 2)).cast("double").alias("v2"),
        A.total_by(F.col("counts"), lambda c: c.cast("double") * c).alias("m2"),
        A.total_by(F.col("tokens"), F.length).alias("letters"),
        A.entropy_bits(F.col("counts"), F.size("tokens").cast("double")).alias("bits"),
        A.mean(F.transform(seg, lambda i: F.size(F.array_distinct(F.slice("tokens", i * 50 + 1, 50))) / lit(50))).alias("segments"),
        S.fit(F.transform(F.slice(F.sort_array("counts", asc=False), 1, 50), lambda c, i: F.struct(F.log(i + lit(1)).alias("x"), F.log(c.cast("double")).alias("y")))).alias("f"),
    )
    n, v, v1, v2, m2 = (F.col(c) for c in ("n", "v", "v1", "v2", "m2"))
    f = {k: F.col(f"f.{k}") for k in ("n", "x", "y", "xy", "xx", "yy")}
    below = f["n"] * f["xx"] - f["x"] * f["x"]
    slope = F.when((n >= 20) & (below != 0), (f["n"] * f["xy"] - f["x"] * f["y"]) / below).otherwise(lit(0))
    spread = f["n"] * f["yy"] - f["y"] * f["y"]
    r = f["n"] * f["xy"] - f["x"] * f["y"]

    def atleast(k: int, x: Column) -> Column:
        return F.when(n >= k, x).otherwise(lit(0))

    out = s.select(
        "doc_id", n.cast("long").alias("n_tokens"), v.cast("long").alias("n_types"),
        A.ratio(v, n).alias("ttr"), A.ratio(v, F.sqrt(n)).alias("root_ttr"), atleast(2, F.log(v) / F.log(n)).alias("log_ttr"),
        F.when(n >= 50, F.col("segments")).otherwise(A.ratio(v, n)).alias("msttr"),
        A.ratio(v1, n).alias("hapax_per_token"), A.ratio(v1, v).alias("hapax_per_type"), A.ratio(v2, n).alias("dis_per_token"), A.ratio(v2, v).alias("sichel_s"),
        atleast(10, lit(10000) * (m2 - n) / (n * n)).alias("yule_k"), A.ratio(lit(10000) * (m2 - v), v * v).alias("yule_k_types"),
        atleast(2, (m2 - n) / (n * (n - 1))).alias("simpson_d"), F.when((n >= 10) & (v1 < v), lit(100) * F.log(n) / (1 - v1 / v)).otherwise(lit(0)).alias("honore_r"),
        atleast(10, F.pow(n, F.pow(v, lit(-0.172)))).alias("brunet_w"), A.ratio(F.col("letters"), n).alias("mean_word_length"),
        F.col("bits").alias("entropy_bits"), F.when(v > 1, F.col("bits") / F.log2(v)).otherwise(lit(0)).alias("normalized_entropy"),
        slope.alias("zipf_slope"), F.when((n >= 20) & (below > 1e-9) & (spread > 1e-9), r * r / (below * spread)).otherwise(lit(0)).alias("zipf_r2"),
        F.when(n >= 20, 1 - F.least(lit(1), F.abs(slope + 1))).otherwise(lit(0.5)).alias("zipf_compliance"),
    )
    return A.fenced(out)


def sequence_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of the sequence of each document's sentence lengths in words."""
    s = segmented(docs, id_col, text_col).select("doc_id", F.transform("sentences", lambda x: F.size(segment.tokens_web(x))).alias("a"))
    a = F.col("a")
    s = s.select(
        "doc_id", "a", F.sort_array("a").alias("o"), F.size("a").cast("double").alias("n"), A.mean(a).alias("m"), A.var_pop(a).alias("v"),
        A.percentile(a, 50).alias("median"), A.percentile(a, 25).alias("p25"), A.percentile(a, 75).alias("p75"), A.skewness(a).alias("skewness"), A.kurtosis(a).alias("kurtosis"), A.gini(a).alias("gini"),
        A.window_variances(a, 5).alias("local"),
    )
    n, m, v, o = F.col("n"), F.col("m"), F.col("v"), F.col("o")
    std = F.sqrt(v)
    cv = F.when((n >= 2) & (m != 0), std / m).otherwise(lit(0))
    low, high = F.get(o, F.floor(n * 0.25).cast("int")), F.get(o, F.floor(n * 0.75).cast("int"))
    spread = F.array_max(o) - F.array_min(o)
    above = F.transform(a, lambda x: (x > F.col("median")).cast("int"))
    n1 = A.total(above)
    n0 = n - n1
    runs = lit(1) + A.total(A.lagged_pairs(above, lambda x, y: (x != y).cast("int")))
    expected = 2 * n0 * n1 / n + 1
    inner = 2 * n0 * n1 * (2 * n0 * n1 - n) / (n * n * (n - 1))
    deviation = F.when(inner > 0, F.sqrt(inner))
    ten = n >= 10
    z = F.when(ten & deviation.isNotNull(), (runs - expected) / deviation).otherwise(lit(0))
    lags = [A.autocorrelation(a, m, v, k) for k in range(1, 11)]

    def like(k: int) -> Column:
        same = A.lagged_pairs(a, lambda x, y: 1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1)), k)
        return A.mean(same)

    first, last = A.mean(F.slice(a, 1, 10)), A.mean(F.slice(a, F.greatest(F.size(a) - 9, F.lit(1)), 10))
    chi = A.total_by(a, lambda x: F.pow(x - m, lit(2)) / m)
    out = s.select(
        "doc_id", n.cast("long").alias("n_sentences"), m.alias("mean"), v.alias("variance"), std.alias("std"), cv.alias("cv"),
        F.coalesce(F.array_min(o), F.lit(0)).cast("long").alias("shortest"), F.coalesce(F.array_max(o), F.lit(0)).cast("long").alias("longest"),
        "median", "p25", "p75", "skewness", "kurtosis", "gini",
        F.when(n >= 2, A.ratio(std - m, std + m)).otherwise(lit(0)).alias("burstiness"),
        F.when(n >= 2, 1 - F.least(lit(1), cv / lit(0.8))).otherwise(lit(0.5)).alias("uniformity"),
        scoring.gaussian(cv, 0.55, 0.15).alias("variance_naturalness"),
        F.when((n >= 4) & (spread > 0), (high - low) / spread).otherwise(lit(0.5)).alias("iqr_ratio"),
        F.when(F.size("local") >= 2, A.uniformity(F.col("local"))).otherwise(lit(0.5)).alias("variance_stability"),
        F.when((n >= 20) & (m != 0), F.least(lit(1), F.abs(last - first) / m)).otherwise(lit(0)).alias("drift"),
        F.when(n >= 20, F.greatest(lit(0), *[like(k) for k in range(2, 11)])).otherwise(lit(0)).alias("periodicity"),
        F.when((n >= 15) & (v > 0), lags[0]).otherwise(lit(0)).alias("lag1"), F.when((n >= 15) & (v > 0), lags[1]).otherwise(lit(0)).alias("lag2"),
        F.when((n >= 15) & (v > 0), F.greatest(*[F.abs(x) for x in lags])).when(n >= 15, lit(1)).otherwise(lit(0)).alias("max_autocorrelation"),
        F.when(ten, runs).otherwise(lit(0)).cast("long").alias("runs"), z.alias("runs_z"), (F.abs(z) < 1.96).alias("runs_random"),
        F.when((n >= 3) & (m > 0), 1 / (1 + chi / (n - 1))).otherwise(lit(0)).alias("chi_uniformity"),
    )
    return A.fenced(out)


def ngram_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 5) -> DataFrame:
    """For each document and n from 2: n-grams, distinct ones, repeated ones, the
    share of the text they cover, and their entropy."""
    s = segmented(docs, id_col, text_col).select("doc_id", "tokens")
    s = s.withColumns({f"g{n}": A.ngrams(F.col("tokens"), n) for n in range(2, longest + 1)})
    s = A.with_run_counts(s, **{f"c{n}": f"g{n}" for n in range(2, longest + 1)})
    rows = []
    for n in range(2, longest + 1):
        c, k = F.col(f"c{n}"), F.size(f"g{n}").cast("double")
        repeated = F.filter(c, lambda x: x > 1)
        rows.append(
            F.struct(
                F.lit(n).alias("n"), F.size(f"g{n}").cast("long").alias("total"), F.size(c).cast("long").alias("n_distinct"), F.size(repeated).cast("long").alias("repeated"),
                A.ratio(F.size(repeated), F.size(c)).alias("repeated_share"), A.ratio(A.total(repeated), k).alias("covered"),
                A.ratio(A.entropy_bits(c, k), F.log2(F.greatest(k, lit(1)))).alias("entropy"),
            )
        )
    return s.select("doc_id", F.inline(F.array(*rows)))


def bigram_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add-one smoothed cross-entropy of each document's bigrams under its own counts.

    Texts of fewer than 12 tokens have entropy 4 and perplexity 50.
    """
    d = segmented(docs, id_col, text_col).select("doc_id", "tokens")
    d = d.withColumn("pairs", F.sort_array(A.ngrams(F.col("tokens"), 2)))
    d = d.withColumn("firsts", F.transform("pairs", lambda x: F.substring_index(x, " ", 1)))
    d = d.withColumn("ends", S.pair_ends(F.col("pairs"), F.col("firsts")))
    kinds = F.size(F.filter("ends", lambda e: e > 0)).cast("double")
    d = d.select("doc_id", F.size("tokens").alias("n_tokens"), "ends", kinds.alias("v"))

    def of_word(a, r):
        """Adds a first word's pairs; how many there are is the length of their run."""
        total = r["b"] - r["a"]
        end = lambda a: F.struct(A.zero().alias("c"), (a["s"] + (a["c"] + 1) * F.log2((a["c"] + 2) / (total + F.col("v")))).alias("s"))
        step = lambda a, e: F.when(e == 0, F.struct((a["c"] + 1).alias("c"), a["s"].alias("s"))).otherwise(end(a))
        return F.aggregate(F.slice("ends", r["a"] + 1, total), a, step)

    bits = F.aggregate(S.words_of_pairs(F.col("ends")), F.struct(A.zero().alias("c"), A.zero().alias("s")), of_word, lambda a: a["s"])
    out = A.fenced(d.select("doc_id", "n_tokens", (-bits / F.greatest(F.col("n_tokens") - 1, F.lit(1))).alias("h")))
    enough = F.col("n_tokens") >= 12
    h = F.when(enough, F.col("h")).otherwise(lit(4))
    perplexity = F.when(enough, F.pow(lit(2), F.col("h"))).otherwise(lit(50))
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), h.alias("entropy"), F.least(lit(500), perplexity).alias("perplexity"), F.when(enough, 1 - scoring.normalize(perplexity, 20, 200)).otherwise(lit(0.5)).alias("predictability"))


def adjacent_similarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mean and variance of the Jaccard similarity of neighbouring sentences' words."""
    s = segmented(docs, id_col, text_col).select("doc_id", F.transform("sentences", segment.tokens_web).alias("w"))
    s = s.select("doc_id", F.size("w").alias("n"), A.lagged_pairs(F.col("w"), A.jaccard).alias("j"))
    return s.select("doc_id", F.col("n").cast("long").alias("n_sentences"), A.mean(F.col("j")).alias("mean_similarity"), A.var_pop(F.col("j")).alias("var_similarity"), F.coalesce(F.array_max("j"), lit(0)).alias("max_similarity"))


def _ranked(d: DataFrame, found: Column, k: int) -> DataFrame:
    """The first k of an array of structs, in their order, as rows with a rank."""
    d = A.fenced(d.select("doc_id", F.slice(F.sort_array(found), 1, k).alias("b")))
    return d.select("doc_id", F.posexplode("b").alias("rank", "w")).withColumn("rank", (F.col("rank") + 1).cast("long"))


def top_words(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k most frequent words of each document; the earlier first, where counts are equal."""
    d = segmented(docs, id_col, text_col).select("doc_id", S.placed(F.col("tokens")).alias("p"))
    d = d.withColumn("ends", A.run_ends(F.col("p"), "w"))
    found = A.runs(F.col("p"), F.col("ends"), lambda first, n: F.struct((-n).cast("long").alias("n"), first["i"].alias("first"), first["w"].alias("word")))
    return _ranked(d, found, k).select("doc_id", "rank", F.col("w.word").alias("word"), (-F.col("w.n")).alias("n"))


def repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """Phrases of four to six words that a document repeats: the k heaviest, weight words times count."""
    d = segmented(docs, id_col, text_col).select("doc_id", "tokens")
    sizes = (4, 5, 6)
    d = d.withColumns({f"g{n}": F.sort_array(F.transform(A.ngrams(F.col("tokens"), n), lambda g: F.struct(g.alias("w")))) for n in sizes})
    d = d.withColumns({f"e{n}": A.run_ends(F.col(f"g{n}"), "w") for n in sizes})

    def again(n: int) -> Column:
        every = A.runs(F.col(f"g{n}"), F.col(f"e{n}"), lambda first, c: F.struct((-c * n).cast("long").alias("weight"), first["w"].alias("phrase"), c.cast("long").alias("n"), F.lit(n).cast("long").alias("words")))
        return F.filter(every, lambda x: x["n"] > 1)

    out = _ranked(d, F.concat(*map(again, sizes)), k)
    return out.select("doc_id", "rank", F.col("w.phrase").alias("phrase"), F.col("w.words").alias("words"), F.col("w.n").alias("n"), (-F.col("w.weight")).alias("weight"))


def segment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many tokens, sentences and paragraphs each convention finds."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = F.col("text")
    d = d.withColumn("k", F.transform(segment.pieces_v1(t), segment.words_by_space))
    size = lambda a: F.size(a).cast("long")
    return d.select(
        "doc_id",
        F.length(F.regexp_replace(t, f"[{segment.SPACE}]+", "")).cast("long").alias("letters"),
        size(segment.tokens_web(t)).alias("tokens_web"), size(segment.tokens_letters(t)).alias("tokens_letters"), size(segment.tokens_ext(t)).alias("tokens_ext"), size(segment.tokens_v1(t)).alias("tokens_v1"),
        size(segment.sentences_flat(t)).alias("sentences_flat"), size(segment.sentences_ext(t)).alias("sentences_ext"),
        size(F.filter("k", lambda k: k >= 2)).alias("sentences_v1"), size(F.filter("k", lambda k: k >= 3)).alias("sentences_v1_long"), size(segment.sentences_v2(t)).alias("sentences_v2"), size(segment.sentences_bench(t)).alias("sentences_bench"),
        size(segment.paragraphs(t)).alias("paragraphs"),
    )
