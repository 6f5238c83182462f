"""Features of rewritten texts: by hand, and against their SQL on texts with many listed words."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstone.functions import artifact_lists as L
from inkstone.operators import artifact_features as V
from inkstone.plans import artifact_sql
from inkstone.plans.registry import rounded


def features(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sent", F.lit(1)).withColumn("n", F.lit("x"))
    return sorted(V.artifact_features(df).collect(), key=lambda r: r["doc_id"])


def test_features_by_hand(spark):
    text = "Well, I don't utilize teh dope. Furthermore, it's cool, you know? Wild, huh? Crazy. I mean, teh vibe is gonna be lit!!"
    (r,) = features(spark, text)
    words = "well i don t utilize teh dope furthermore it s cool you know wild huh crazy i mean teh vibe is gonna be lit".split()
    assert (r["word_count"], r["sentence_count"]) == (len(words), 5)
    assert r["contraction_count"] == 3 and r["informal_contraction_count"] == 1
    assert r["disfluency_count"] == 3 and r["disfluency_variety"] == 1  # well, you know, i mean
    assert r["sentence_start_disfluency_count"] == 1  # starts are those of lines
    assert (r["typo_count"], r["typo_position_variance"]) == (2, 0) and r["typo_density"] == pytest.approx(2 / len(words) * 100)
    assert (r["formal_word_count"], r["slang_count"]) == (2, 4)
    assert r["rhetorical_question_count"] == 2 and r["fragment_count"] == 1 and r["double_punct_count"] == 1
    assert r["formal_structure_casual_language"] == 1 and r["technical_with_typos"] == 0 and r["ai_phrase_count"] == 1
    assert r["composite_humanization_score"] == pytest.approx((1 + 1) / 6)
    assert r["unique_word_ratio"] == pytest.approx(len(set(words)) / len(words))


def test_words_end_at_letters_of_any_script(spark):
    (r,) = features(spark, "café naïve élet's don't word x1 a_b plain")
    assert r["word_count"] == 5  # s, don, t, word, plain
    assert r["contraction_count"] == 1  # no edge before the l of élet's


def test_null_empty_and_short_texts_have_no_features(spark):
    for r in features(spark, None, "", "   \n     ", "a short"):
        assert all(r[k] == 0 for k in V.NAMES)
    assert V.artifact_features(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def documents():
    r = random.Random(5)
    words = [w for ws in L.WORDS.values() for w in ws] + ["don't", "It's", "gonna", "just'cause", "'bout", "dunno", "I mean,", "you know", "kind of", "um", "été", "наука", "x2", "well"]
    phrases = L.STOCK_PHRASES + L.PASSIVES + L.FRAGMENTS + ["right? ", "Wild, huh? ", "make sense? ", "...", "--", "—", "!!", "?!"]
    starts = ["Well, ", "So, ", "Thing is, ", "\nAnyway, ", "Right, ", "The "]
    rows = [(0, None), (1, "word " * 400), (2, "Ünï çødé, ничего нет? " * 9), (3, "... !!! ??? . ")]
    for i in range(4, 60):
        out = []
        for _ in range(r.randrange(0, 25)):
            out.append(r.choice(starts + [""] * 5) + " ".join(r.choice(words) if r.random() < 0.9 else r.choice(phrases) for _ in range(r.randrange(1, 30))) + r.choice([". ", "! ", "? ", ".", "\n"]))
        rows.append((i, "".join(out)))
    return rows


def test_rows_of_the_sql(spark):
    rows = documents()
    found = rounded(V.artifact_features(spark.createDataFrame(rows, "doc_id long, text string"))).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.register("frame", pd.DataFrame(rows, columns=["doc_id", "text"]))
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    wanted = c.execute(artifact_sql.ARTIFACTS).df().sort_values("doc_id").reset_index(drop=True)[list(found.columns)]
    for k in found.columns:
        assert list(found[k]) == pytest.approx(list(wanted[k]), abs=1e-6), k
