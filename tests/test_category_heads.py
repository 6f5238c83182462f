"""The heads come from one reading of the documents; quicker patterns count the same."""

from pyspark.sql import functions as F

from inkstone.functions import voice_lists as L
from inkstone.operators import voice_categories as V
from inkstone.plans import registry
from tests.conftest import DATA

TEXTS = ["a.b.c.d e.f", "x.y.z", "aaa queue_ue beeeau eau9", "a..b a.b..c", "  \n  One. two", "The end", "thesis The", "Running on", "running_ on", "Abc  Def", "'q", "12 x", "", "a.b.c.d.e.f. g", "éaaa aaaé 1.2.3.4"]


def test_documents_are_read_once(spark):
    plan = registry.QUERIES["category_heads"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_quicker_patterns_find_the_same(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    pairs = [(V._times(F.col("text"), p), V._times(F.col("text"), q)) for p, q in V.SAME_SLIPS.items()]
    pairs += [(F.col("text").rlike(V._java(p)), F.regexp_extract("text", V.at_start(p), 0) != "") for p in L.OPENING_KINDS]
    for r in df.select(*[c.alias(str(i)) for i, c in enumerate(x for pair in pairs for x in pair)]).collect():
        assert list(r)[::2] == list(r)[1::2]
