"""Work on a text grows with its length, not with its square."""

import time

from inkstone.operators import model_features, rewriting_signals, style_categories


def test_entropies_of_a_long_text_take_one_pass(spark):
    words = 60_000
    text = " ".join(f"w{i}" for i in range(words))
    start = time.time()
    (r,) = model_features.tone_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert abs(r["pair_entropy"] - 1) < 1e-9 and abs(r["triple_entropy"] - 1) < 1e-9
    assert time.time() - start < 60  # the sum of all counts, anew for each count, would be 10^10 additions


def _timed(spark, operator, text):
    start = time.time()
    (r,) = operator(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return r, time.time() - start


def test_signals_of_long_sentences_and_of_many_take_one_pass(spark):
    long = "A, " + ", ".join("word" for _ in range(30_000)) + ". "
    many = "".join("one two three four. " if i % 2 else "five six. " for i in range(6_000))
    r, seconds = _timed(spark, rewriting_signals.rewriting_signals, long + many)
    assert r["verdict"] and 0 < r["punctuation_position_entropy"] <= 1
    assert seconds < 60  # the sentence cut anew for each of its words would be 10^9 signs; each window summed anew 7 * 10^6 sums


def test_templates_of_a_long_line_take_one_pass(spark):
    r, seconds = _timed(spark, style_categories.set_pieces, "However. " + "While x " * 40_000)
    assert r["name"] and seconds < 60  # the rest of the line, read anew from each "while", would be 6 * 10^9 signs
