"""The 37 ordered features of the classic extractor, one row for each document.

Deviations are those of samples (n - 1), unlike in the other statistics. Texts of
fewer than ten words or two sentences have all features 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import segment
from inkstone.functions.arrays import lit
from inkstone.functions.series import fit

#: In the order of the feature vector (fixed values).
NAMES = """sentence_count avg_sentence_length sentence_length_cv sentence_length_std sentence_length_min sentence_length_max
sentence_length_range sentence_length_skewness sentence_length_kurtosis word_count unique_word_count type_token_ratio hapax_count
hapax_ratio dis_legomena_ratio zipf_slope zipf_r_squared zipf_residual_std burstiness_sentence burstiness_word_length avg_word_length
word_length_cv syllable_ratio flesch_kincaid_grade automated_readability_index bigram_repetition_rate trigram_repetition_rate
sentence_similarity_avg comma_rate semicolon_rate question_rate exclamation_rate paragraph_count avg_paragraph_length
paragraph_length_cv overall_uniformity complexity_cv""".split()


def _std(a: Column) -> Column:
    """Of a sample; 0 below two values."""
    n = A.size(a)
    return F.when(F.size(a) >= 2, F.sqrt(A.var_pop(a) * n / (n - 1))).otherwise(lit(0))


def _cv(a: Column) -> Column:
    return A.ratio(_std(a), A.mean(a))


def _burst(a: Column) -> Column:
    s, m = _std(a), A.mean(a)
    return F.when(F.size(a) >= 2, A.ratio(s - m, s + m)).otherwise(lit(0))


def classic_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", segment.tokens_v1(F.col("text")).alias("w"), segment.sentences_v1(F.col("text")).alias("s"), segment.paragraphs(F.col("text")).alias("p"))

    def sizes(words: Column) -> Column:
        found = F.filter(F.transform(words, F.size), lambda n: n > 0)
        return A.let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(1))))

    d = d.withColumns({"sw": F.transform("s", segment.tokens_v1), "pw": F.transform("p", segment.tokens_v1)})
    d = d.withColumns(
        {
            "a": sizes(F.col("sw")), "para": sizes(F.col("pw")), "k": F.transform("w", F.length), "pair": A.ngrams(F.col("w"), 2), "triple": A.ngrams(F.col("w"), 3),
            "y": F.aggregate(F.transform("w", segment.syllables_v1), F.lit(0), lambda x, v: x + v),
        }
    )
    d = A.with_run_counts(d, counts="w", pairs="pair", triples="triple")
    d = d.withColumns(
        {
            "f": fit(F.transform(F.sort_array("counts", asc=False), lambda c, i: F.struct(F.log(i + lit(1)).alias("x"), F.log(c.cast("double")).alias("y")))),
            "sim": F.filter(A.lagged_pairs(F.col("sw"), lambda x, z: F.when((F.size(x) > 0) | (F.size(z) > 0), A.jaccard(x, z))), lambda v: v.isNotNull()),
            "std": _std(F.col("a")), "mean": A.mean(F.col("a")), "var": A.var_pop(F.col("a")),
        }
    )
    n, v, s = F.size("w").cast("double"), F.size("counts").cast("double"), F.size("s").cast("double")
    f = {k: F.col(f"f.{k}") for k in ("n", "x", "y", "xy", "xx", "yy")}
    below, spread = f["n"] * f["xx"] - f["x"] * f["x"], f["n"] * f["yy"] - f["y"] * f["y"]
    slope = (f["n"] * f["xy"] - f["x"] * f["y"]) / below
    left = F.greatest(lit(0), spread - slope * slope * below) / (f["n"] * f["n"])
    many = v >= 5
    a, std = F.col("a"), F.col("std")
    m, k = A.size(a), lit
    signs = F.length(F.regexp_replace("text", f"[{segment.SPACE}]", ""))

    def repeated(c: str, least: int) -> Column:
        return F.when(n >= least, A.ratio(F.size(F.filter(c, lambda x: x > 1)), F.size(c))).otherwise(lit(0))

    cv = A.ratio(std, F.col("mean"))
    once, twice = F.size(F.filter("counts", lambda c: c == 1)), F.size(F.filter("counts", lambda c: c == 2))
    values = [
        s, F.col("mean"), cv, std, F.array_min(a), F.array_max(a), F.array_max(a) - F.array_min(a),
        F.when((F.size(a) >= 3) & (std > 0), m * A.moment(a, 3) / (std * std * std) * m / ((m - 1) * (m - 2))).otherwise(k(0)), F.when((F.size(a) >= 4) & (std > 0), A.moment(a, 4) / F.pow(std, k(4)) - 3).otherwise(k(0)),
        n, v, A.ratio(v, n), once, A.ratio(once, v), A.ratio(twice, v),
        F.when(many, slope).otherwise(k(-1)), F.when(many & (spread > 1e-9), slope * slope * below / spread).otherwise(k(0)), F.when(many, F.sqrt(left)).otherwise(k(0)),
        _burst(a), _burst(F.slice("k", 1, 100)), A.mean(F.col("k")), _cv(F.col("k")), A.ratio(F.col("y"), n),
        k(0.39) * n / s + k(11.8) * F.col("y") / n - k(15.59), k(4.71) * signs / n + k(0.5) * n / s - k(21.43),
        repeated("pairs", 3), repeated("triples", 4), A.mean(F.col("sim")),
        *[F.regexp_count("text", F.lit(p)) / s for p in (",", ";", r"\?", "!")],
        F.size("p"), A.mean(F.col("para")), _cv(F.col("para")), 1 - cv, cv,
    ]
    enough = (n >= 10) & (s >= 2)
    return A.fenced(d.select("doc_id", *[F.when(enough, x.cast("double")).otherwise(k(0)).alias(name) for name, x in zip(NAMES, values, strict=True)]))


def as_vector(features: DataFrame, names: list[str] = NAMES, output: str = "features") -> DataFrame:
    """The features as one vector column, for Spark's classifiers."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol=output).transform(features)
