"""Counts of words and pairs by cheaper ways than before, against plain loops."""

from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import processing_lists, segment, series
from inkstone.operators import charts, processing, statistics

WORDS = ["a b a c a b".split(), [], ["x"], [f"w{i % 50}" for i in range(300)], [f"w{i % 7}" for i in range(90)]]


def test_products_of_few_and_of_many_common_words(spark):
    rows = [(a, b) for a in WORDS for b in WORDS]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select(processing.products(F.col("a"), F.col("b")), processing.squares(F.col("a"))).collect()
    for (a, b), (xy, xx) in zip(rows, got, strict=True):
        x, y = Counter(a), Counter(b)
        assert xy == sum(x[t] * y[t] for t in x) and xx == sum(v * v for v in x.values())


def test_pairs_of_a_first_word_are_a_run(spark):
    words = "a b a c a b a_ a b".split()
    pairs = sorted(f"{x} {y}" for x, y in zip(words, words[1:]))
    df = spark.createDataFrame([(pairs, [p.split()[0] for p in pairs])], "p array<string>, f array<string>").withColumn("e", series.pair_ends(F.col("p"), F.col("f")))
    (r,) = df.select("e", series.words_of_pairs(F.col("e")).alias("w")).collect()
    assert [tuple(x) for x in r["w"]] == [(0, 4), (4, 5), (5, 7), (7, 8)] and r["e"] == [0, 0, 1, 2, 2, 1, 2, 2]


def test_perplexity_by_hand(spark):
    words = "a b a c a b d a b c a a b".split()
    pairs, firsts = Counter(zip(words, words[1:])), Counter(words[:-1])
    h = -sum(c * log2((c + 1) / (firsts[a] + len(pairs))) for (a, _), c in pairs.items()) / (len(words) - 1)
    (r,) = statistics.bigram_perplexity(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert abs(r["entropy"] - h) < 1e-12


@pytest.mark.parametrize("pattern", [processing_lists.CLAUSES, processing_lists.POLYSEMOUS, processing_lists.VERBS])
def test_listed_words_are_what_their_pattern_finds(spark, pattern):
    text = "THAT bank-which was_ wásé is, when K set9 set doés DO"
    own = F.transform(F.regexp_extract_all("t", F.lit("[A-Za-z0-9_]+"), 0), F.lower)
    (r,) = spark.createDataFrame([(text,)], "t string").select(processing._n(F.col("t"), pattern).alias("a"), F.size(F.filter(own, lambda w: w.isin(*processing._alone(pattern)))).alias("b")).collect()
    assert r["a"] == r["b"] > 0


def test_repeats_by_place_are_counted_without_a_lambda(spark):
    text = " ".join(["one two three"] * 8 + ["four five six seven"])
    rows = charts.repetition_map(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    words = text.split()
    for n in (2, 5):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        many = Counter(grams)
        wanted = Counter(i * 20 // len(grams) for i, g in enumerate(grams) if many[g] > 1)
        assert {r["segment"]: r["repeats"] for r in rows if r["n"] == n} == {s: wanted[s] for s in range(20)}


def test_running_sums_and_syllables(spark):
    for n in (0, 1, 64, 65, 200):
        values = [i * 7 % 11 for i in range(n)]
        (r,) = spark.createDataFrame([(values,)], "a array<int>").select(A.running(F.col("a")).alias("s")).collect()
        assert r["s"] == [float(sum(values[:i])) for i in range(n + 1)]
    df = spark.createDataFrame([(w,) for w in ("table", "the", "whale", "queue", "rhythm", "don't")], "w string")
    assert [tuple(r) for r in df.select(segment.syllables(F.col("w")), segment.syllables_v1(F.col("w"))).collect()] == [(1, 2), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1)]
