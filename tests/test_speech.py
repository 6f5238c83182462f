"""The correction for formal speeches."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkstone.operators import speech as V
from inkstone.plans import speech_sql
from inkstone.plans.registry import rounded

TEXTS = [
    None, "", "A plain text.", "Honorable delegates, my name is Ana and I am representing Chile. Our committee met. Thank you.",
    "Hello everyone, my name is Zoë and I am here. Today I will speak. In my opinion it might be so, perhaps, maybe.", "Distinguished delegates! " * 9 + "I'm the delegate",
    "my name is\nAna. hello\nmy name is Bo", "the delegate of Türkiye", "i think that i believe that let me begin as a student i guess somewhat a bit",
]


def test_speeches(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("low", F.lit(1))
    r = {x["doc_id"]: x for x in V.speech_correction(df).collect()}
    assert [r[i]["correction"] for i in (0, 1, 2)] == [0, 0, 0]
    # honorable delegates 3, named and representing 3, representing 3, our committee 2, thank you 1; an introduction
    assert r[3]["speech"] == 12 and r[3]["introduced"] and r[3]["correction"] == pytest.approx(0.6)
    assert r[4]["n_student"] == 4 and r[4]["n_uncertain"] == 3 and r[4]["correction"] == pytest.approx(0.16 + 0.1 + 0.06)
    assert r[5]["speech"] == 27 and r[5]["correction"] == pytest.approx(0.6)
    assert V.speech_correction(df.limit(0)).collect() == []


def test_rows_of_the_sql(spark):
    rows = list(enumerate(TEXTS))
    found = rounded(V.speech_correction(spark.createDataFrame(rows, "doc_id long, text string"))).toPandas().sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.register("frame", pd.DataFrame(rows, columns=["doc_id", "text"]))
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    wanted = c.execute(speech_sql.SPEECH).df().sort_values("doc_id").reset_index(drop=True)[list(found.columns)]
    assert found.values.tolist() == wanted.values.tolist()


def test_corrected(spark):
    rows = [r["y"] for r in spark.createDataFrame([(0.9, 0.0), (0.9, 0.55), (0.3, 0.6)], "p double, c double").select(V.corrected(F.col("p"), F.col("c")).alias("y")).collect()]
    assert [(round(r["ai_probability"], 9), r["label"], r["level"]) for r in rows] == [(0.9, "AI", "Very High"), (0.35, "HUMAN", "Low"), (0.0, "HUMAN", "Very High")]
