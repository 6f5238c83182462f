"""Sequence statistics, sentence scores, charts, signals and coherence by plain Python or by hand."""

import math
import re
from collections import Counter

import pytest

from inkstone.operators import charts, processing, rewriting_signals, sentence_scores, sequences, statistics

TEXT = "the cat saw the dog and the bird saw the cat. a long winter followed the short summer of that strange year! nobody saw the bird again"


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, tokens string")


def one(df):
    (r,) = df.collect()
    return r


def words(text):
    return re.findall(r"\b[a-z'-]+\b", text.lower())


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values())


def test_sequences_by_plain_python(spark):
    w = words(TEXT)
    r = one(sequences.word_sequences(frame(spark, TEXT)))
    pairs = list(zip(w, w[1:]))
    assert r["n_words"] == len(w) and r["word_bits"] == pytest.approx(entropy(w)) and r["pair_bits"] == pytest.approx(entropy(pairs))
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
    assert r["transition_bits"] == pytest.approx(sum(map(entropy, follow.values())) / len(follow))
    gaps = {t: [j - i for i, j in zip(p, p[1:])] for t in set(w) for p in [[i for i, x in enumerate(w) if x == t]]}

    def burst(g):
        m = sum(g) / len(g)
        sd = math.sqrt(sum((x - m) ** 2 for x in g) / len(g))
        return (sd - m) / (sd + m)

    back = [g for g in gaps.values() if g]
    every = [x for g in back for x in g]
    assert r["return_burstiness"] == pytest.approx(sum(map(burst, back)) / len(back))
    assert r["return_mean"] == pytest.approx(sum(every) / len(every))
    k = [len(x) for x in w]
    m = sum(k) / len(k)
    sd = math.sqrt(sum((x - m) ** 2 for x in k) / len(k))
    c = [sum(x - m for x in k[: i + 1]) for i in range(len(k))]
    assert r["hurst"] == pytest.approx(math.log((max(c) - min(c)) / sd) / math.log(len(k)))
    assert r["length_lag1"] == pytest.approx(sum((a - m) * (b - m) for a, b in zip(k, k[1:])) / ((len(k) - 1) * sd * sd))


def test_growth_counts_words_at_every_fiftieth_and_at_the_end(spark):
    w = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i % 7]}" for i in range(130)]
    got = [(r["position"], r["n_types"]) for r in sequences.vocabulary_growth(frame(spark, " ".join(w), "", None, "one")).collect()]
    assert sorted(got) == sorted([(1, 1)] + [(p, len(set(w[:p]))) for p in (50, 100, 130)])
    exact = sequences.vocabulary_growth(frame(spark, " ".join(w[:100]))).collect()
    assert [(r["position"], r["n_types"]) for r in exact] == [(50, len(set(w[:50]))), (100, len(set(w[:100])))]


ALL = [
    sequences.word_sequences, sequences.vocabulary_growth, sentence_scores.sentence_scores, sentence_scores.document_trends, charts.cooccurrence_edges, charts.cooccurrence_nodes, charts.repetition_map, charts.length_histogram,
    rewriting_signals.rewriting_signals, processing.processing_difficulty, processing.text_coherence, statistics.top_words, statistics.repeated_phrases, statistics.bigram_perplexity,
]


@pytest.mark.parametrize("operator", ALL, ids=lambda f: f.__name__)
def test_odd_texts_and_repeated_rows(spark, operator):
    texts = ["", None, "  \n\n ", "word", "... !!! ???", "\U0001f600 \U0001f600", "a" * 3000, TEXT, TEXT]
    twice = [(9, TEXT), (9, TEXT)]  # two rows of one id are two documents
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in [*enumerate(texts), *twice]], "doc_id long, text string, n int, tokens string")
    rows = operator(df).collect()
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)
    of = [sorted(str(tuple(r)[1:]) for r in rows if r["doc_id"] == i) for i in (7, 8, 9)]
    assert of[0] == of[1] and of[2] == sorted(of[0] * 2)
    assert operator(df.limit(0)).collect() == []


def test_sentences_are_scored_beside_their_neighbours(spark):
    text = "One two three four. One two three four five six. However, I may go. Perhaps we might, could and may seem to."
    rows = sorted(sentence_scores.sentence_scores(frame(spark, text)).collect(), key=lambda r: r["no"])
    assert [r["n_tokens"] for r in rows] == [4, 6, 4, 8]
    assert [r["regularity"] for r in rows] == [0.5, 0.5, pytest.approx(1 - 3 / 7), 0.5]
    assert [r["markers"] for r in rows] == [0, 0, pytest.approx(0.3), 0] and [r["personal"] for r in rows] == [0, 0, pytest.approx(0.2), pytest.approx(0.2)]
    assert [r["hedging"] for r in rows] == [0, 0, 0.25, 1.0] and {r["surprise"] for r in rows} == {0.5}


def test_graph_counts_pairs_within_the_window(spark):
    text = "alpha beta gamma alpha beta gamma alpha beta delta delta epsilon the of and to in it is on at"
    content = text.split()[:11]
    want, first = Counter(), {}
    for i in range(len(content) - 3):
        for t, (j, k) in enumerate(((0, 1), (0, 2), (1, 2))):
            a, b = sorted((content[i + j], content[i + k]))
            if a != b:
                want[a, b] += 1
                first.setdefault((a, b), 3 * i + t)
    edges = charts.cooccurrence_edges(frame(spark, text)).collect()
    assert [(r["word"], r["other"], r["weight"]) for r in sorted(edges, key=lambda r: r["rank"])] == [(*p, want[p]) for p in sorted(want, key=lambda p: (-want[p], first[p]))]
    nodes = {r["word"]: r["degree"] for r in charts.cooccurrence_nodes(frame(spark, text)).collect()}
    assert nodes == {w: sum(c for p, c in want.items() if w in p) for w in {x for p in want for x in p}}
    assert charts.cooccurrence_edges(frame(spark, "alpha beta gamma " * 6)).count() == 0  # too few words


def test_a_pronoun_reaches_back_to_the_last_name_of_its_sentence(spark):
    r = one(processing.processing_difficulty(frame(spark, "Anna saw Bert and then he left. so they stayed while it rained on Carl")))
    # 'he' three words after Bert; 'they' and 'it' have no name before them in their sentence
    assert r["referent_distance"] == 3


def test_halves_of_other_words_diverge_wholly(spark):
    a, b = (one(processing.text_coherence(frame(spark, t))) for t in ("Red green blue black. " * 4 + "Sun moon star sky. " * 4, "Red green blue black. " * 8))
    assert a["halves_js"] == pytest.approx(1) and b["halves_js"] == 0 and b["mean_similarity"] == pytest.approx(1) and a["mean_similarity"] == pytest.approx(6 / 7)


def test_signals_of_an_even_text(spark):
    even = "The good cat helps the big dog. " * 12
    r, short = rewriting_signals.rewriting_signals(frame(spark, even, "too short")).collect()
    assert (r["variance_stability"], r["parallelism_score"], r["autocorr_flatness"], r["autocorr_periodicity"]) == (1, 1, 1, 0)
    assert r["structure_template_score"] == pytest.approx(1 / 12, abs=1e-8) and r["rare_synonym_ratio"] == 0 and "variance" in r["flags"].split(",")
    assert (short["probability"], short["verdict"], short["flags"], short["comma_density"]) == (0.5, "INSUFFICIENT DATA", "", None)
