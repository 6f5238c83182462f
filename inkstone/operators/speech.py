"""Correction of a probability for formal speeches, which seem more even than they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import arrays as A
from inkstone.functions import matching
from inkstone.functions import scoring as S
from inkstone.functions import speech_lists as L
from inkstone.functions.arrays import lit
from inkstone.operators.artifact_features import OTHER_WORD
from inkstone.operators.voice_categories import _java

LEVELS = [(0.2, "Very Low"), (0.4, "Low"), (0.6, "Moderate"), (0.8, "High")]


def _pattern(p: str) -> str:
    return _java(p.replace(r"\w", "[A-Za-z0-9_]"))


def speech_correction(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``correction`` (0 to 0.6) by the signs of a delegate's speech, a student, uncertainty and an
    introduction, with the counts. Null and empty texts have none."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), OTHER_WORD, "0").alias("low"))
    many = lambda patterns: sum((matching.times(F.col("low"), p, F.lit(_pattern(p)), F.col("low")) for p in patterns), F.lit(0))
    d = d.select(
        "doc_id", *[many(patterns).alias(f"w{w}") for w, patterns in L.SPEECH_SIGNS.items()], many(L.STUDENT_SIGNS).alias("n_student"), many(L.UNCERTAIN_SIGNS).alias("n_uncertain"),
        (F.greatest(*[matching.found(F.col("low"), p, _pattern(p), F.col("low")) for p in L.INTRODUCTION_SIGNS]) > 0).alias("introduced"),
    )
    d = d.withColumn("speech", sum((F.col(f"w{w}") * w for w in L.SPEECH_SIGNS), F.lit(0)))
    speech = F.when(F.col("speech") >= 6, F.least(lit(0.5), F.col("speech") * 0.05)).when(F.col("speech") >= 3, F.least(lit(0.3), F.col("speech") * 0.05)).otherwise(lit(0))
    student = F.when(F.col("n_student") >= 3, F.least(lit(0.2), F.col("n_student") * 0.04)).otherwise(lit(0))
    unsure = F.when(F.col("n_uncertain") >= 2, F.least(lit(0.1), F.col("n_uncertain") * 0.02)).otherwise(lit(0))
    total = F.least(lit(0.6), speech + student + F.when(F.col("introduced"), 0.1).otherwise(0.0) + unsure)
    return A.fenced(d.select("doc_id", "speech", "n_student", "n_uncertain", "introduced", total.alias("correction")))


def corrected(p: Column, correction: Column) -> Column:
    """Probability, label and level of sureness after the correction."""
    q = F.greatest(lit(0), p - correction)
    sure = F.abs(q - 0.5) * 2
    return F.struct(q.alias("ai_probability"), F.when(q >= 0.5, "AI").otherwise("HUMAN").alias("label"), sure.alias("confidence"), S.ladder(sure, LEVELS, "Very High").alias("level"))
