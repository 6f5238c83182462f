"""The style categories on texts whose results can be worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkstone.operators import style_categories as C


def result(spark, operator, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("scores", F.lit("clash"))
    return [r for r in sorted(operator(df).collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("operator", C.STYLE_CATEGORIES.values())
def test_short_empty_and_null_texts_are_undecided(spark, operator):
    for r in result(spark, operator, "", None, "  \n", "One short text."):
        assert (r["ai_probability"], r["confidence"]) == (0.5, 0.0)
    assert operator(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_archaic_style(spark):
    plain = "The old house stands near the river and nobody goes there in winter because the road is full of snow."
    old = "Thou knowest the computer. " * 4 + "Thou art wise and thou runs away. He goes. She speaketh well. You may go hence."
    r = result(spark, C.archaic, plain, old)
    assert (r[0]["ai_probability"], r[0]["confidence"]) == (0.5, 0.3)
    # 6 of 8 sentences have old forms; thou and you mix; 'knowest' four times and 'speaketh' against one modern form
    sentences = re.split(r"(?<=[.!?])\s+(?=[A-Z])", old)
    has = sum(bool(re.search(r"\b(thou|knowest|art|speaketh|hence)\b", s.lower())) for s in sentences)
    surface = 1 - (0.4 * has / len(sentences) + 0 + 0.3)
    morphology = 1 - (4 + 1) / 7  # six after 'thou', of which 'runs' is wrong; the third person mixes
    assert r[1]["ai_probability"] == pytest.approx(0.4 * surface + 0.3 * (1 / 3) + 0.3 * morphology)
    assert r[1]["confidence"] == pytest.approx(0.5)


def test_repeated_phrases_are_those_of_the_pattern(spark):
    r = random.Random(1)
    lines = [" ".join(r.choice(["a", "b", "C", "c", "dd", "e,", "f"]) + r.choice(["", "", "", "  "]) for _ in range(r.randrange(0, 40))) for _ in range(120)] + ["x " * 60, "", "a b c d", "a b c d. a b c d"]
    pattern = re.compile(r"\b(\w+\s+\w+\s+\w+\s+\w+)\b.*\b\1\b", re.I | re.A)
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, column in C.phrase_repeats(F.split("text", "\n")).items():
        d = d.withColumn(name, column)
    got = {x["doc_id"]: x["repeats"] for x in d.select("doc_id", "repeats").collect()}
    assert got == {i: sum(len(pattern.findall(line)) for line in t.split("\n")) for i, t in enumerate(texts)}


def test_predictability(spark):
    text = " ".join(f"It is important to note the fact that number{i} of the list is a word." for i in range(6))
    r = result(spark, C.predictability, text)[0]
    tokens = re.findall(r"[a-z0-9_'-]+", text.lower())
    grams = lambda n: [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
    again = {n: round(100 * (len(grams(n)) - len(set(grams(n)))) / len(grams(n)), 1) for n in (3, 4)}
    assert min(again[3] / 5, 1) == 1 and min(again[4] / 3, 1) == 1
    repeats = len(re.findall(r"\b(\w+\s+\w+\s+\w+\s+\w+)\b.*\b\1\b", text, re.I))
    import math

    counts = [tokens.count(w) for w in set(tokens)]
    h = -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in counts) / math.log2(len(counts))
    low = 1 - min(1, max(0, (h - 0.7) / 0.25))
    assert r["ai_probability"] == pytest.approx(0.25 * 1 + 0.25 * 1 + 0.3 * (0.7 + 0.3 * min(1, repeats / 3)) + 0.2 * low)
    assert r["confidence"] == 0.4


def test_consistency_of_authorship(spark):
    sentence = "The calm river runs past a green hill."
    even = "\n\n".join(" ".join([sentence] * 5) for _ in range(4))
    r = result(spark, C.consistency, even, " ".join([sentence] * 11 + ["Because which, that; while: if when although, because which that, while if."]))
    assert r[0]["ai_probability"] == pytest.approx(0.25 * 0.6 + 0 + 0 + 0.2 * 0.3) and r[0]["confidence"] == 0.5
    # one paragraph: halves and words aren't compared; the last but one sentence is a drop
    assert r[1]["ai_probability"] == pytest.approx(0.25 * 0.5 + 0.3 * 1 / (12 * 0.15) + 0.2 * 0.5) and r[1]["confidence"] == 0.3


def test_set_pieces(spark):
    text = "In today's world we look. It may be so.\n\nFirst, a benefit. Second, a drawback. Finally, a good bad thing.\n\nIn conclusion, on one hand yes. There are both sides here.\n\nOverall, it may be clear."
    r = result(spark, C.set_pieces, text)[0]
    assert r["confidence"] == 0.4
    balanced = 1 / 3 * 0.5 + 0.5  # one template; two words for, two against
    hedging = min(1, (1 / 8) / 0.2) * 0.5 + 0.5  # 'it may be' in eight sentences, and no firm word
    sizes = [2, 3, 2, 1]
    paras = [re.findall(r"[a-z0-9_'-]+", p.lower()) for p in text.split("\n\n")]
    words = [len(p) for p in paras]

    def cv(a):
        m = sum(a) / len(a)
        return (sum((x - m) ** 2 for x in a) / len(a)) ** 0.5 / m

    clip = lambda x: min(1, max(0, x))
    inner = cv([3, 3, 5])
    symmetry = 0.3 * (1 - clip((cv(words) - 0.2) / 0.4)) + 0.3 * (1 - clip((cv(sizes) - 0.3) / 0.4)) + 0.4 * clip((inner < 0.3) / 2)
    arc = (1 + 1 + 1) / 4 * 0.5 + 0.3 + 0.2 * clip(3 / 5)  # introduction, 'Overall', three marks of order
    assistant = clip(1 / 5)  # 'In conclusion'
    assert r["ai_probability"] == pytest.approx(0.2 * balanced + 0.2 * hedging + 0.15 * symmetry + 0.25 * arc + 0.2 * assistant)


def test_traces_of_rewriting(spark):
    text = "Well, it's teh plan and we don't mind it. So, moreover it's cool that you're here now dude. I mean, they're gonna utilize it and it's comprehensive, right? Furthermore that's fine, don't you think?"
    r = result(spark, C.rewriting, text)[0]
    per = [3, 2, 3, 2]  # 'Well' is 'we'll' without its sign
    m = sum(per) / 4
    c = (sum((x - m) ** 2 for x in per) / 4) ** 0.5 / m
    fillers, loose, left = 3, 3, 2
    want = 0.2 * (1 - c) * 0.7 + 0.15 * 1 + 0.2 * 0.4 + 0.15 * min(1, 4 * 2 / 20) + 0.2 * min(1, left * (loose + fillers) / 15) + 0.1 * 0
    assert r["ai_probability"] == pytest.approx(want)
