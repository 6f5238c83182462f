"""Entropy of a text's signs."""

import math
from collections import Counter

from pyspark.sql import functions as F

from inkstone.operators import sequences


def test_bits_of_letters_count_all_signs(spark):
    texts = ["abcabc", "zé1é!!aa", "ÉÉ--", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sequences.letter_bits(F.col("t"))).collect()]
    assert [round(x, 9) for x in got] == [round(-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()), 9) if t else 0 for t in texts]
