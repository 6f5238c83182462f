"""Rewriting in place by hand, and the voice categories against their SQL on texts with many listed words,
which the prose of the test tables seldom has."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstone.operators import stability as R
from inkstone.operators import voice_categories as V
from inkstone.plans import stability_sql, voice_sql
from inkstone.plans.registry import rounded

TEXTS = [
    "The good dog sat. It was Important to help.", "Good news, everyone.", "nothing listed here",
]


def one(spark, f, texts):
    return [r["y"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", f(F.col("x")).alias("y")).sort("i").collect()]


def test_synonyms(spark):
    assert one(spark, R.with_synonym, TEXTS + ["They Delve, deep", "go-od men", ""]) == ["The great dog sat. It was Important to help.", "Great news, everyone.", None, "They Explore, deep", None, None]


def test_clauses(spark):
    texts = ["However, he left", "When it rains, we stay, always", "He left because it rained", "None fits", ""]
    assert one(spark, R.with_clauses_moved, texts) == ["he left, however", "always, when it rains, we stay", "Because it rained, he left", None, None]


def test_commas(spark):
    assert one(spark, R.with_comma_changed, ["a, b, c", "a and b and c", "a but b", "a"]) == ["a b, c", "a, and b and c", "a, but b", None]


def test_swaps(spark):
    texts = ["A big red thing and a small new idea", "He quickly ran", "He ran quickly"]
    assert one(spark, R.with_words_swapped, texts) == ["A red big thing and a small new idea", "Quickly, he ran", None]


def test_null_short_and_empty_texts_are_undecided(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, " \n"), (3, "One. " * 90)], "doc_id long, text string").withColumn("sentences", F.lit(1))
    r = {x["doc_id"]: x for x in R.stability(df).collect()}
    assert {(r[i]["ai_probability"], r[i]["confidence"]) for i in (0, 1, 2)} == {(0.5, 0.0)}
    assert r[3]["scores"]["structure"] == 0.5 and r[3]["scores"]["even_lengths"] == 1  # nothing to rewrite
    assert R.stability(df.limit(0)).collect() == []


WORDS = """good important show help I we you he it perhaps maybe certainly always love terrible therefore moreover gonna really just clearly quickly slowly happily
thinks walked walking is are was will because although while data study analysis step code said Monday felt eyes lol literally please team can't don't
thing idea time way and but however the a results beaauty in fact as a result""".split()
OPENERS = ["However, ", "When it rains, ", "In conclusion, ", "It is important to note that ", "I think ", "He quickly ", "Great question! ", "\"Well,\" ", "The Old House ", "What ", "Going ", "7 "]


def documents():
    r = random.Random(3)
    rows = [(0, None), (1, ""), (2, "  "), (3, "Ünï çødé — ничего нет. " * 20), (4, "!!! ??? ... " * 30)]
    for i in range(5, 45):
        out = []
        for _ in range(r.randrange(1, 40)):
            body = " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ";"]) for _ in range(r.randrange(1, 25)))
            out.append(r.choice(OPENERS + [""] * 6) + body + r.choice([". ", "! ", "? ", ". ", ".\n\n", "...  "]))
            if r.random() < 0.2:
                out.append(out[-1])
        rows.append((i, "".join(x[:1].upper() + x[1:] for x in out)))
    return rows


PAIRS = {name: (op, voice_sql.VOICE[name]) for name, op in V.VOICE_CATEGORIES.items()} | {"stability": (R.stability, stability_sql.STABILITY), "relative": (V.relative_scores, voice_sql.RELATIVE)}


@pytest.mark.parametrize("name", PAIRS)
def test_rows_of_the_sql_on_texts_with_many_listed_words(spark, name):
    operator, sql = PAIRS[name]
    rows = documents()
    found = rounded(operator(spark.createDataFrame(rows, "doc_id long, text string")).drop("scores")).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.register("frame", pd.DataFrame(rows, columns=["doc_id", "text"]))
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    wanted = c.execute(sql).df().sort_values("doc_id").reset_index(drop=True)[list(found.columns)]
    for k in found.columns:
        for i, (a, b) in enumerate(zip(found[k], wanted[k], strict=True)):
            assert (pd.isna(a) and pd.isna(b)) or (a == pytest.approx(b, abs=1e-6) if isinstance(a, float) else a == b), (k, i, a, b)
