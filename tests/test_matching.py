"""The search before a pattern, and trimming without a pattern."""

import re

import pytest
from pyspark.sql import functions as F

from inkstone.functions import matching, segment, series
from inkstone.operators import rewrite, speech, style_categories
from inkstone.plans import registry
from tests.conftest import DATA


@pytest.mark.parametrize(
    "pattern, pieces",
    [
        (r"(?i)\bthe\s+the\b", ["the"]), (r"(?i)\b(?:no wait|scratch that)\b", ["no wait", "scratch that"]), (r"(?i)\bIt(?:'s)? (?:Is|was) clear\b", [" clear"]),
        (r"(?i)(?:perhaps)?", []), (r"[!?]{2,}", []), (r"(?:a|\d)", []), (r"é+", []), (r"[\x{A0}]", []), (r"(?:ab){2}", ["ab"]),
    ],
)
def test_every_match_holds_a_piece(pattern, pieces):
    assert matching.needed(pattern) == pieces


def test_counts_are_those_of_the_pattern(spark):
    patterns = [r"(?i)\bthe\s+the\b", r"(?i)\b(?:no wait|scratch that)\b", r"[!?]{2,}"]
    texts = ["The  THE the", "Scratch that! No wait?! scratch thats", "", "İSTANBUL the THE"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(*[matching.times(F.col("text"), p, F.lit(p)).alias(str(i)) for i, p in enumerate(patterns)]).collect()
    assert [tuple(r) for r in got] == [tuple(len(re.findall(p, t)) for p in patterns) for t in texts]


def test_only_the_ends_white_space_is_trimmed(spark):
    ends = "﻿　 \n\t\x0b\f\r\xa0       "
    texts = [ends + "a" + ends + "b" + ends, ends, "", "​a ", "a \x85"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(segment.trim(F.col("text"))).collect()]
    assert got == ["a" + ends + "b", "", "", "​a", "a \x85"]  # the last was cut before, as a pattern's end also stands before a last line end


def test_abbreviations_of_any_case_end_no_v1_sentence(spark):
    df = spark.createDataFrame([("MRS. Smith met dr. Jones etc. in town. They talked a lot. Bye.",)], "text string")
    (r,) = df.select(segment.sentences_v1(F.col("text")).alias("s")).collect()
    assert r["s"] == ["MRS. Smith met dr. Jones etc. in town", "They talked a lot"]


@pytest.mark.parametrize(
    "pattern, half",
    [
        (r"(?i)\b(?:was|[A-Za-z0-9_]+ed)\b", "(?i)<(?:was|[A-Za-z0-9_]+ed)>"), (r"\bi'?m\s+\w+\b", r"<i'?m\s+\w+\b"), (r"\b'cause\b", r"\b'cause>"), (r"\b[a-z]*x\b", r"\b[a-z]*x>"),
        (r"(\b[a-z]+\b)\s", r"(<[a-z]+>)\s"), (r"\b(?:i\.e\.|x)\b", r"\b(?:i\.e\.|x)\b".replace(r"\b(", "<(", 1)), (r"\b[^a]\b", r"\b[^a]\b"),
    ],
)
def test_edges_beside_a_sure_word_sign_look_to_one_side(pattern, half):
    assert matching.half_edges(pattern).replace(matching.BEHIND, "<").replace(matching.AHEAD, ">") == half


def test_contractions_have_the_edges_of_the_whole_pattern(spark):
    words = ["don'?t", "gonna", "'?cause", "'bout"]
    whole = segment.EDGE + "(?:" + "|".join(words) + ")" + segment.EDGE
    texts = ["dont don't xdon't don'ts", "just'cause 'cause cause", "a'bout 'bout", "gonna_ gonnaé gonna"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(F.regexp_extract_all("text", F.lit(style_categories._edged(words)), 0), F.regexp_extract_all("text", F.lit(whole), 0)).collect()
    assert all(a == b for a, b in rows) and [len(a) for a, _ in rows] == [2, 3, 1, 2]


@pytest.mark.parametrize("text", ["while a however", "however while", "WHILE\nhowever", "while while however while", "x\r\nwhile  however", ""])
def test_two_parts_in_a_line_are_found_from_the_first(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    (r,) = df.select(F.col("text").rlike("(?i)while.*however").alias("a"), F.col("text").rlike(matching.in_a_line("(?i)while.*however")).alias("b")).collect()
    assert r["a"] == r["b"]


def test_grams_come_in_the_order_of_words_and_places(spark):
    words = "b a b a a_ b a' b a b".split()
    (r,) = spark.createDataFrame([(words,)], "w array<string>").select(series.sorted_grams(F.col("w"), 2).alias("g")).collect()
    assert [tuple(x) for x in r["g"]] == sorted((f"{x} {y}", i) for i, (x, y) in enumerate(zip(words, words[1:])))


def test_a_phrase_that_another_leaves_behind_is_replaced_too(spark):
    df = spark.createDataFrame([("An ABCcb a",), ("bc",), ("none",)], "_text string")
    entries = [("abc", "(?i)abc", "b"), ("bcb", "(?i)bcb", "z"), ("none", "(?i)none", "")]
    assert [r[0] for r in df.select(rewrite._replaced(F.col("_text"), entries, "0", 2.0)).collect()] == ["An z a", "bc", ""]


def test_a_sign_of_a_speech_is_searched_for_by_its_words(spark):
    texts = ["Hello delegates, thank you", "hello  \n delegates; I'm not sure", "Perhaps it seems so", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plan = speech.speech_correction(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains") >= 30  # no pattern runs on a text without its words
    assert [(r["speech"], r["n_uncertain"]) for r in speech.speech_correction(df).sort("doc_id").collect()] == [(4, 0), (3, 1), (0, 2), (0, 0)]


def test_a_table_is_dealt_out_in_bounded_pieces(spark, monkeypatch):
    docs = registry.table(spark, DATA, "documents")
    cores = spark.sparkContext.defaultParallelism
    assert registry.QUERIES["report_lines"](spark, DATA).rdd.getNumPartitions() == cores
    monkeypatch.setattr(registry, "PIECE", 10_000)
    assert registry.spread(docs).rdd.getNumPartitions() > cores
