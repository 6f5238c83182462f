"""Array statistics and segmenters on inputs with known results."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import scoring as S
from inkstone.functions import segment


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def numbers(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=4, max_size=20))
def test_moments_and_percentiles(xs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    a, x = numbers(*xs), np.array(xs, dtype=float)
    got = spark.range(1).select(A.mean(a).alias("m"), A.var_pop(a).alias("v"), A.percentile(a, 30).alias("p"), A.gini(a).alias("g")).first()
    assert got["m"] == pytest.approx(x.mean()) and got["v"] == pytest.approx(x.var(), abs=1e-6) and got["p"] == pytest.approx(np.percentile(x, 30))
    s = np.sort(x)
    assert got["g"] == pytest.approx(sum((2 * (i + 1) - len(s) - 1) * v for i, v in enumerate(s)) / (len(s) ** 2 * x.mean()))


def test_edge_cases_of_arrays(spark):
    none, one, even = numbers(), numbers(5), numbers(6, 6, 6, 6, 6)
    assert value(spark, A.mean(none)) == 0 and value(spark, A.cv(one)) == 0 and value(spark, A.uniformity(one)) == 0.5
    assert value(spark, A.cv(even)) == 0 and value(spark, A.uniformity(even)) == 1 and value(spark, A.burstiness(even)) == -1
    assert value(spark, A.skewness(even)) == 0 and value(spark, A.kurtosis(even)) == 0 and value(spark, A.percentile(none, 50)) == 0
    assert value(spark, A.window_variances(one, 5)) == [] and value(spark, A.ngrams(F.array(F.lit("a")), 2)) == []
    assert value(spark, A.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"]
    assert value(spark, A.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert value(spark, A.cosine(numbers(1, 0), numbers(1, 1))) == pytest.approx(math.sqrt(0.5)) and value(spark, A.cosine(numbers(0, 0), numbers(1, 1))) == 0
    df = A.with_run_counts(spark.range(1).select(F.array(*map(F.lit, "abacab")).alias("w")), c="w")
    assert sorted(df.first()["c"]) == [1, 2, 3]
    assert A.with_run_counts(spark.range(1).select(F.array().cast("array<string>").alias("w")), c="w").first()["c"] == []


@pytest.mark.parametrize(
    ("text", "sentences"),
    [
        ("", []), ("Dr. Lee met Mr. Kim. They left.", ["Dr. Lee met Mr. Kim.", "They left."]), ("He moved to the U.S. They stayed.", ["He moved to the U.S. They stayed."]),
        ("It is so! Really? yes. No", ["It is so!", "Really? yes.", "No"]), ("One. Mr. Two. Three", ["One. Mr. Two.", "Three"]), ("a. B", ["a.", "B"]),
    ],
)
def test_web_sentences(spark, text, sentences):
    got = value(spark, segment.sentences_web(F.lit(text)))
    assert got == sentences


def test_tokens_by_convention(spark):
    t = F.lit("café naïve well-known don't X1 'tis")
    assert value(spark, segment.tokens_web(t)) == ["caf", "na", "ve", "well-known", "don't", "x1", "'tis"]
    assert value(spark, segment.tokens_letters(t)) == ["caf", "na", "ve", "well", "known", "don", "t", "tis"]
    assert value(spark, segment.tokens_ext(t)) == ["caf", "na", "ve", "well-known", "don't", "tis"]
    assert value(spark, segment.tokens_v1(t)) == ["caf", "na", "ve", "well-known", "don't", "x", "'tis"]
    assert value(spark, segment.paragraphs(F.lit("a\n\nb\n \t\nc\n\n\n"))) == ["a", "b", "c"]
    assert [value(spark, segment.syllables(F.lit(w))) for w in ("the", "table", "like", "banana", "rhythm", "area")] == [1, 1, 1, 3, 1, 2]


def test_scores(spark):
    assert value(spark, S.human_likelihood(F.lit(0.55), S.BASELINES["sentence_length_cv"])) == 1
    assert value(spark, S.verdict_label(F.lit(0.2))) == "Probably Human" and value(spark, S.verdict_label(F.lit(0.8))) == "AI"
    low, high = S.wilson(F.lit(0.5), F.lit(0.0))
    assert value(spark, low) == pytest.approx(0.5 - 1.96 * math.sqrt((0.25 + 0.9604) / 1) / 4.8416) and value(spark, high) == pytest.approx(1 - value(spark, low))
    assert value(spark, S.calibrate(F.lit(0.3))) == pytest.approx(0.25) and value(spark, S.calibrate(F.lit(1.5))) == 1.5
    assert value(spark, S.combine_log_odds([F.lit(0.9), F.lit(0.1)], [1, 1])) == pytest.approx(0.5)
    assert value(spark, S.normalize(F.lit(3.0), 1, 2)) == 1 and value(spark, S.probability_band(F.lit(0.5))) == "uncertain"
