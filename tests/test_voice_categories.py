"""The voice categories on texts whose results can be worked out by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from inkstone.operators import voice_categories as V


def result(spark, operator, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("scores", F.lit("clash")).withColumn("tokens", F.lit(1))
    return sorted(operator(df).collect(), key=lambda r: r["doc_id"])


@pytest.mark.parametrize("operator", V.VOICE_CATEGORIES.values())
def test_short_empty_and_null_texts_are_undecided(spark, operator):
    for r in result(spark, operator, "", None, "  \n", "One short text."):
        assert (r["ai_probability"], r["confidence"]) == (0.5, 0.0)
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_text_that_never_changes_its_tone_is_steady(spark):
    same = "The house stands near the river. " * 6
    turns = "Therefore we must certainly act thus. Yeah it is just super cool stuff. " * 3
    a, b = result(spark, V.tone, same, turns)
    # registers and certainty are a half throughout; no rate is over 0; all are even
    assert a["scores"]["steady"] == 1 and a["scores"]["shifts"] == 0 and a["scores"]["smooth"] == 1
    assert a["ai_probability"] == pytest.approx(0.2 + 0.15 + 0.2 + 0.1 + 0.1 + 0.05)
    assert b["scores"]["shifts"] >= 5 and b["scores"]["smooth"] == 0 and b["ai_probability"] < a["ai_probability"]


def test_an_assistants_phrases_count(spark):
    (r,) = result(spark, V.tone, "Great question! I'd be happy to help with that. " + "The house stands near the river. " * 4)
    # two patterns; 'great question', 'i'd be happy', 'happy to help'; both as openings
    assert r["scores"]["helper"] == 1


def test_word_classes_find_tense_and_places(spark):
    past = "Clearly the man walked home. He quickly opened the door. The dog barked at him loudly. " * 2
    (r,) = result(spark, V.word_classes, past)
    # 'clearly' in front and 'quickly' in the first third, 'loudly' at the end, each twice
    assert r["scores"]["front"] == pytest.approx(4 / 6, abs=1e-6)
    assert r["scores"]["one_tense"] == 1
    assert r["ai_probability"] == pytest.approx(0.5 + 0.1 + 0.1)
    assert r["confidence"] == pytest.approx(0.5)  # six adverbs


def test_gaps_of_repeated_phrases(spark):
    phrase = "one two three four five six seven eight nine ten"
    (r,) = result(spark, V.repetition, " ".join([phrase] * 12))
    assert r["scores"]["even_gaps"] == 1 and r["scores"]["clustered"] == 0  # each returns after ten words
    # all ten phrases most frequent have the gap 10, so they are even too
    assert r["ai_probability"] == pytest.approx(0.3 + 0.25 + 0 + 0.2 * 0.5 + 0.1)


def test_alike_paragraphs_are_all_counted_up_to_the_bound(spark):
    words = ["alpha beta gamma delta", "alpha beta gamma omega", "red green blue white", "red green blue black", "sun moon star sky"]
    text = "\n\n".join(f"{w} {w} {w} {w}." for w in words)
    (r,) = result(spark, V.repetition, text)
    pairs = sum(len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) > 0.3 for a, b in itertools.combinations(words, 2))
    assert pairs == 2 and r["scores"]["redundant"] == pytest.approx(min(1, (pairs / 4 * 0.4) * 2))
    many = "\n\n".join(["the same words in every paragraph"] * 300)
    assert result(spark, V.repetition, many)[0]["scores"]["redundant"] == 1


def test_inconsistency_of_equal_segments(spark):
    (r,) = result(spark, V.inconsistency, "The old house stands near the river in winter. " * 12)
    # one kind of opening for all twelve, equal segments, no slips
    assert r["scores"]["openings"] == pytest.approx(1 - (0.6 + 0.4 * 11 / 12), abs=1e-6)
    assert r["scores"]["idioms"] == r["scores"]["complexity"] == r["scores"]["drift"] == r["scores"]["segments"] == 0
    assert r["ai_probability"] == pytest.approx(0.15 * (0.4 - 0.4 * 11 / 12) + 0.15 * 0.8 + 0.2)


def test_heads_weigh_categories_by_confidence(spark):
    rows = [(1, "a", 1, 0.9, 0.5), (1, "b", 2, 0.6, 0.25), (1, "c", 13, 0.1, 1.0), (1, "d", 9, 0.9, 0.1), (2, "e", 99, 0.9, 0.9)]
    a, b = sorted(V.heads(spark.createDataFrame(rows, "doc_id long, name string, category int, ai_probability double, confidence double")).collect())
    assert a["syntax"] == pytest.approx(0.8) and a["authorship"] == pytest.approx(0.1) and a["errors"] == 0.5
    assert a["ai_probability"] == pytest.approx(0.8 * 0.15 + 0.1 * 0.15 + 0.5 * 0.7)
    assert (a["n_conflicts"], a["conflict"]) == (1, pytest.approx(0.7))
    assert (b["ai_probability"], b["agreement"], b["n_conflicts"]) == (pytest.approx(0.5), 1.0, 0)


def test_relative_scores_name_the_kind_of_writing(spark):
    text = "The study presents an analysis of the data. Significant results of the research are reported, i.e. the findings. " * 3
    r = result(spark, V.relative_scores, text, "short", None)
    # two of the three patterns, 2 each: there is no word edge between the last full stop of 'i.e.' and a space
    assert r[0]["cohort"] == "academic" and r[0]["cohort_confidence"] == pytest.approx(0.4)
    assert [(x["cohort"], x["relative_score"], x["confidence"], x["mean_abs_z"]) for x in r[1:]] == [("general", 0.5, 0.0, None)] * 2
    p = spark.range(1).select(V.adjusted(F.lit(0.8), F.lit(0.2), F.lit(0.5)).alias("p")).first()["p"]
    assert p == pytest.approx(0.8 * 0.85 + 0.2 * 0.15)


def test_a_variance_of_whole_lengths_is_exact(spark):
    lengths = [12, 14, 10, 15, 8, 7, 10, 4, 4]  # variance 14: the z-score is -2, which is no outlier
    text = " ".join("Aa" + " bb" * (k - 1) + "." for k in lengths)
    (r,) = result(spark, V.relative_scores, text)
    assert r["z_burstiness"] == -2.0 and r["n_outliers"] == sum(abs(r[f"z_{k}"]) > 2 for k in V.L.MEASURES)
